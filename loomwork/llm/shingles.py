"""Near copies by the Jaccard similarity of word shingles: an exact join of shingle sets by prefixes, rare shingles first.

The fingerprint of simhash.py links hardly any edited copy within two bits;
this finds all of those too. Shingles have one order, those of crowded cells
of a count sketch last. Two sets that share 4 of 5 of their union share a
shingle among the first fifth of each, so texts that have such a shingle in
common are all candidates, and none other is. Any order gives the same links;
a good one makes few candidates.
Small buckets of texts with a shingle are compared pair by pair. The members
of a crowded one are compared with one of them; then those whom no links join
to most others there meet all of it, in blocks of their numbers: pairs whose
sizes and places leave room for enough shared shingles go on, each once for all
buckets. Only blocks of very many such pairs compare whole sets. So no pair is
left out but of texts that links join already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomwork.llm import simhash
from loomwork.llm.components import connected_components
from loomwork.llm.shared import LOWER_AZ, materialize, numbered, utf8

WIDTH = 5
#: Two texts are near copies if their sets share 4 of 5 shingles of their union.
SHARE = (4, 5)
#: Of two texts with a shingle at places at and at_b: whether it may be the first that they share, which leaves room for all others that they must share.
ROOM = f"{sum(SHARE)} * least(n - at, n_b - at_b) >= {SHARE[0]} * (n + n_b)"
#: Cells of the count sketch that orders shingles, a power of two.
CELLS = 1 << 18
#: Buckets of up to so many members are compared pair by pair.
SMALL_BUCKET = 16
#: Shingles, and texts, of one side of a block, about.
BLOCK_SHINGLES, BLOCK_TEXTS = 200_000, 1_024
#: Blocks of more pairs a text than this that may be near copies compare whole sets.
DENSE = 64


def shingles_of(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's word shingles; fewer words are one shingle, no words none."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = zip(*(words[k:] for k in range(width)), strict=False) if len(words) > width else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs)), dtype=np.uint64))


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def prefix_of(hashes: np.ndarray, crowding: np.ndarray) -> np.ndarray:
    """The first shingles of a set by the crowding of their cells, then by value: so many that a set that reaches SHARE with it has one of them among its own."""
    part, whole = SHARE
    first = len(hashes) - -(-part * len(hashes) // whole) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, crowding[cells_of(hashes)]))[:first]]


def bits_of(hashes: np.ndarray) -> bytes:
    """A bitmap of a set, of four bits a shingle or more, a power of two: the lowest bits of each shingle name its bit."""
    size = max(64, 1 << (4 * len(hashes)).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_share(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """The most shingles that two sets of n_a and n_b may share: each bit of one bitmap alone is a shingle of one set alone."""
    x, y = np.unpackbits(np.frombuffer(a, dtype=np.uint8)), np.unpackbits(np.frombuffer(b, dtype=np.uint8))
    size = min(len(x), len(y))
    x, y = x.reshape(-1, size).max(axis=0), y.reshape(-1, size).max(axis=0)
    both = np.count_nonzero(x & y)
    return min(n_a - np.count_nonzero(x) + both, n_b - np.count_nonzero(y) + both)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    values = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def shingle_set(text: Column) -> Column:
    """The shingle set of each text as an array of longs."""

    @arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        return _lists([shingles_of(t) for t in utf8(texts)])

    return of(text)


def _likely(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Whether the bitmaps of two sets leave it open that they reach SHARE."""
    part, whole = SHARE

    @arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array, n_left: pa.Array, n_right: pa.Array) -> pa.Array:
        found = []
        for x, y, n, m in zip(left.to_pylist(), right.to_pylist(), n_left.to_pylist(), n_right.to_pylist(), strict=True):
            found.append((part + whole) * may_share(x, y, n, m) >= part * (n + m))
        return pa.array(found, pa.bool_())

    return of(a, b, n_a, n_b)


def crowding(texts: DataFrame) -> np.ndarray:
    """Four times the binary logarithm of the shingles in each of ``CELLS`` cells, over all rows of ``texts`` (text).

    Tasks count in a table of that size; what reaches the driver is one row a cell, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, waiting = np.zeros(CELLS, dtype=np.int64), [], 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                held.append(cells_of(shingles_of(text)))
                waiting += len(held[-1])
                if waiting > CELLS:
                    n += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, waiting = [], 0
        if held:
            n += np.bincount(np.concatenate(held), minlength=CELLS)
        cells = np.flatnonzero(n)
        yield pa.record_batch({"cell": pa.array(cells, pa.int32()), "n": pa.array(n[cells], pa.int64())})

    counts = texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counts.select("cell", F.floor(4 * F.log2(F.col("n") + 1)).cast("short").alias("level")).toArrow()
    found = np.zeros(CELLS, dtype=np.uint8)
    found[rows["cell"].to_numpy()] = np.minimum(rows["level"].to_numpy(), 255)
    return found


def text_keys(text: Column, levels) -> Column:
    """A struct of a text's words as a 128-bit digest, its number of different shingles, its prefix and its bitmap. Takes a broadcast of crowding()."""

    @arrow_udf("same binary, n int, keys array<long>, bits binary")
    def of(texts: pa.Array) -> pa.Array:
        same, n, keys, bits = [], [], [], []
        for t in utf8(texts):
            found = shingles_of(t)
            same.append(xxhash.xxh3_128_digest(b" ".join(t.translate(LOWER_AZ).split())))
            n.append(len(found))
            keys.append(prefix_of(found, levels.value))
            bits.append(bits_of(found))
        return pa.StructArray.from_arrays([pa.array(same, pa.binary()), pa.array(n, pa.int32()), _lists(keys), pa.array(bits, pa.binary())], names=["same", "n", "keys", "bits"])

    return of(text)


def _similar(a: Column, b: Column) -> Column:
    """Whether two shingle sets reach SHARE."""
    part, whole = SHARE

    @arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(left, right, strict=True):
            x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both > 0 and whole * both >= part * (len(x) + len(y) - both))
        return pa.array(found, pa.bool_())

    return of(a, b)


def _shared(a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many values each set of ``a`` (values, and the set each is of) shares with each of ``b``."""
    both = np.intersect1d(a, b)
    common = np.zeros(shape, dtype=np.float32)
    if not len(both):
        return common.astype(np.int64)
    at_a, at_b = np.searchsorted(both, a), np.searchsorted(both, b)
    held_a, held_b = both[np.minimum(at_a, len(both) - 1)] == a, both[np.minimum(at_b, len(both) - 1)] == b
    at_a, a_of, at_b, b_of = at_a[held_a], a_of[held_a], at_b[held_b], b_of[held_b]
    pairs = np.bincount(at_a, minlength=len(both)) * np.bincount(at_b, minlength=len(both))
    # Values of many sets go through products of matrices, others pair by pair.
    often = pairs * 100 > shape[0] * shape[1]
    place = np.where(often, np.cumsum(often) - 1, -1)
    for first in range(0, int(often.sum()), 2048):
        sides = []
        for at, of, sets in ((at_a, a_of, shape[0]), (at_b, b_of, shape[1])):
            column = place[at] - first
            inside = (place[at] >= 0) & (column >= 0) & (column < 2048)
            sides.append(np.zeros((sets, 2048), dtype=np.float32))
            sides[-1][of[inside], column[inside]] = 1
        common += sides[0] @ sides[1].T
    common = common.astype(np.int64)
    seldom_a, seldom_b = ~often[at_a], ~often[at_b]
    at_a, a_of, at_b, b_of = at_a[seldom_a], a_of[seldom_a], at_b[seldom_b], b_of[seldom_b]
    order = np.argsort(at_b, kind="stable")
    at_b, b_of = at_b[order], b_of[order]
    starts, ends = np.searchsorted(at_b, at_a, "left"), np.searchsorted(at_b, at_a, "right")
    upto = np.cumsum(ends - starts)
    first = 0
    while first < len(at_a):  # some million pairs at once
        last = max(int(np.searchsorted(upto, (upto[first - 1] if first else 0) + 4_000_000)), first + 1)
        n = (ends - starts)[first:last]
        each = np.repeat(starts[first:last] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common += np.bincount(np.repeat(a_of[first:last], n) * shape[1] + b_of[each], minlength=shape[0] * shape[1]).reshape(shape)
        first = last
    return common


def _block(table: pa.Table) -> pa.Table:
    """The pairs of roots (u, v) that similar sets of a block's two sides join."""
    part, whole = SHARE
    sides = []
    for left in (True, False):
        half = table.filter(pa.compute.equal(table["left"], left))
        sets = half["set"].combine_chunks()
        n = np.diff(sets.offsets.to_numpy())
        sides.append((sets.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), n, half["root"].to_numpy()))
    (a, a_of, n_a, root_a), (b, b_of, n_b, root_b) = sides
    common = _shared(a, a_of, b, b_of, (len(n_a), len(n_b)))
    alike = (common > 0) & (whole * common >= part * (n_a[:, None] + n_b[None, :] - common)) & (root_a[:, None] != root_b[None, :])
    u, v = np.nonzero(alike)
    found = np.unique(np.stack([np.maximum(root_a[u], root_b[v]), np.minimum(root_a[u], root_b[v])], axis=1), axis=0)
    return pa.table({"u": pa.array(found[:, 0], pa.int64()), "v": pa.array(found[:, 1], pa.int64())})


def _by_row(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """row and shingle set of the distinct rows ``wanted`` (row)."""
    wanted = materialize(wanted.distinct(), "shingle-wanted")  # mostly few, so that they are sent and texts stay where they are
    return materialize(texts.join(wanted, "row").select("row", shingle_set(F.col("text")).alias("set")), "shingle-sets")


def _links_of(pairs: DataFrame, firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of those of ``pairs`` (row, row_b, u, v) that are near copies; bitmaps settle most pairs, whole sets the rest."""
    pairs = pairs.select(F.greatest("row", "row_b").alias("row"), F.least("row", "row_b").alias("row_b"), F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = materialize(pairs.dropDuplicates(["row", "row_b"]), "shingle-pairs")
    maps = firsts.join(materialize(pairs.select("row").union(pairs.select("row_b")).distinct(), "shingle-wanted"), "row").select("row", "bits", "n")
    maps = materialize(maps, "shingle-bits")
    likely = pairs.join(maps.toDF("row", "a", "n_a"), "row").join(maps.toDF("row_b", "b", "n_b"), "row_b").filter(_likely(F.col("a"), F.col("b"), F.col("n_a"), F.col("n_b")))
    pairs = materialize(likely.select("u", "v", "row", "row_b"), "shingle-likely")
    sets = _by_row(pairs.select("row").union(pairs.select("row_b")), texts)
    held = pairs.join(sets.withColumnRenamed("set", "a"), "row").join(sets.toDF("row_b", "b"), "row_b")
    return materialize(held.filter(_similar(F.col("a"), F.col("b"))).select("u", "v"), "shingle-links")


def shared_keys(firsts: DataFrame) -> DataFrame:
    """Table of row, at, key, m (the members of the key's bucket), node and n: the prefix shingles that texts have in common.

    ``firsts`` (node, row, n, keys) has a row for each text; ``keys`` is its prefix, ``at`` a place in it.
    """
    every = firsts.select("row", F.posexplode("keys").alias("at", "key"))
    # Nearly all keys are one text's alone: they are counted without the rest of the row, and only shared ones go on.
    shared = materialize(every.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shingle-keys")
    found = materialize(every.join(shared, "key"), "shingle-found")
    return materialize(found.join(firsts.select("row", "node", "n"), "row"), "shingle-shared")


def near_links(members: DataFrame, firsts: DataFrame, texts: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links (u, v) between near copies among ``members`` (of shared_keys()): all of small buckets, in crowded ones those of one member.

    ``firsts`` (row, n, bits) has bitmaps, which settle most pairs, ``texts`` (row, text) the texts. That member is the one with the fewest
    rarer shingles, as it is likest the others. Give rows read from storage.
    """
    part, whole = SHARE
    few, crowded = members.filter(F.col("m") <= small_bucket), members.filter(F.col("m") > small_bucket)
    other = few.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "row", "n", "at")])
    pairs = few.join(other, "key").filter(f"row_b < row and {ROOM}")
    chosen = crowded.groupBy("key").agg(F.min(F.struct("at", "row", "node", "n")).alias("x")).select("key", *[F.col(f"x.{c}").alias(f"{c}_b") for c in ("node", "row", "n", "at")])
    pairs = pairs.unionByName(crowded.join(chosen, "key").filter("row_b != row"))
    pairs = pairs.filter(f"node != node_b and {whole} * least(n, n_b) >= {part} * greatest(n, n_b)")
    return _links_of(pairs.select("row", "row_b", F.col("node").alias("u"), F.col("node_b").alias("v")), firsts, texts)


def links_left(
    members: DataFrame, roots: DataFrame, firsts: DataFrame, texts: DataFrame, small_bucket: int = SMALL_BUCKET, block_shingles: int = BLOCK_SHINGLES, dense: int = DENSE
) -> DataFrame | None:
    """Links (u, v) between roots, for near copies in crowded buckets that no links join yet; None if crowded buckets have no such members.

    ``roots`` (node, root) has every node. In a bucket, members of other roots
    than most of it have are compared with all of it. Members of like sizes are
    dealt at random to blocks of about ``block_shingles`` shingles a side. What
    meets in a block are rows, sizes and places; pairs that these leave open
    are told once, however many buckets they share. A block of over ``dense``
    such pairs a text compares whole sets and tells no pair.
    """
    part, whole = SHARE
    crowded = members.filter(F.col("m") > small_bucket).select("key", "node", "row", "n", "at").join(roots, "node")
    main = crowded.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    # Sets that reach SHARE are in one class of sizes or in neighbours, and their first shared shingle stands early in the smaller one.
    size = F.floor(F.log("n") / F.log(F.lit(1.01 * whole / part))).cast("int")
    early = F.expr(f"{part + whole} * (n - at) >= {2 * part} * n")
    mixed = crowded.join(main.filter("roots > 1"), "key").select("key", "row", "n", "at", "root", (F.col("root") != F.col("main")).alias("minor"), early.alias("early"), size.alias("size"))
    mixed = materialize(mixed, "shingle-mixed")
    if mixed.isEmpty():
        return None
    kind = ["key", "minor", "early", "size"]
    cut = mixed.groupBy(*kind).agg(F.ceil(F.greatest(F.sum(F.col("n").cast("long")) / block_shingles, F.count("*") / BLOCK_TEXTS)).alias("chunks"))
    dealt = mixed.join(cut, kind).withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks"))
    one = dealt.groupBy(*kind, "chunk").agg(F.count("*").alias("texts"))
    a, b = one.filter("minor").drop("minor"), one.toDF("key", "minor_b", "early_b", "size_b", "chunk_b", "texts_b")
    # Minor chunks meet each other once, and all chunks of the others.
    met = a.join(b, "key").filter("(early or early_b) and abs(size - size_b) <= 1 and (not minor_b or struct(early, size, chunk) <= struct(early_b, size_b, chunk_b))")
    met = materialize(met.withColumn("block", F.struct("key", "early", "size", "chunk", "minor_b", "early_b", "size_b", "chunk_b")), "shingle-blocks")

    def sides(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        left = dealt.filter("minor").join(blocks.select("block", "key", "early", "size", "chunk"), ["key", "early", "size", "chunk"])
        right = dealt.join(blocks.select("block", "key", *[F.col(f"{c}_b").alias(c) for c in ("minor", "early", "size", "chunk")]), [*kind, "chunk"])
        return left.select("block", "row", "n", "at", "root"), right.select("block", "row", "n", "at", "root")

    def open_pairs(blocks: DataFrame) -> DataFrame:
        left, right = sides(blocks)
        return left.join(right.toDF("block", "row_b", "n_b", "at_b", "root_b"), "block").filter(f"root != root_b and {ROOM} and {whole} * least(n, n_b) >= {part} * greatest(n, n_b)")

    found, most = [], f"{dense} * (texts + texts_b)"
    large = met.filter(f"texts * texts_b > {most}")
    if not large.isEmpty():
        pairs = open_pairs(large).groupBy("block").agg(F.count("*").alias("pairs"))
        full = materialize(large.join(pairs, "block").filter(f"pairs > {most}").drop("pairs"), "shingle-full")
        if not full.isEmpty():
            left, right = sides(full)
            held = left.select("block", "row", "root", F.lit(True).alias("left")).union(right.select("block", "row", "root", F.lit(False).alias("left")))
            held = held.join(_by_row(held.select("row"), texts), "row").select("block", "left", "root", "set")
            found.append(materialize(held.groupBy("block").applyInArrow(_block, "u long, v long").distinct(), "shingle-left"))
            met = met.join(full.select("block"), "block", "left_anti")
    found.append(_links_of(open_pairs(met).select("row", "row_b", F.col("root").alias("u"), F.col("root_b").alias("v")), firsts, texts))
    return found[0].union(found[-1]) if len(found) > 1 else found[0]


def keep_one(docs: DataFrame, radius: int = 2, small_bucket: int = SMALL_BUCKET, block_shingles: int = BLOCK_SHINGLES, dense: int = DENSE) -> DataFrame:
    """``docs`` with one row of each group that SimHash links of at most ``radius`` bits and near copies make together.

    Of a group the row of the least doc_id stays (null ids last, of equals any
    one). Rows of one fingerprint are one node of the graph; every different
    text among them brings its own links. Null and word-less texts share
    fingerprint zero; very long texts are read whole; repeated rows are told
    apart by an id of their own in a written copy; other columns pass through
    whatever their names; an empty table stays so.
    """
    names, (held, at) = docs.columns, numbered(docs)
    text = F.col(at["text"])
    levels = docs.sparkSession.sparkContext.broadcast(crowding(held.select(text.alias("text"))))
    held = held.withColumns({"row": F.monotonically_increasing_id(), "fp": simhash.fingerprint(text), "of": text_keys(text, levels)})
    held = materialize(held, "shingle-docs")
    levels.destroy()
    order = (F.col(at["doc_id"]).isNull().alias("no"), F.col(at["doc_id"]).alias("id"), F.col("row"))
    firsts = held.groupBy(F.col("fp").alias("node"), "of.same").agg(F.min(F.struct(*order, "of.n", "of.keys", "of.bits")).alias("x"))
    firsts = materialize(firsts.select("node", F.struct("x.no", "x.id", "x.row").alias("o"), "x.row", "x.n", "x.keys", "x.bits"), "shingle-firsts")
    nodes = materialize(firsts.groupBy("node").agg(F.min("o").alias("o")), "shingle-nodes")
    texts, members = held.select("row", text.alias("text")), shared_keys(firsts)
    edges = simhash.links(nodes.select(F.col("node").alias("fp")), radius).union(near_links(members, firsts, texts, small_bucket))
    roots = nodes.join(connected_components(edges), "node", "left").select("node", "o", F.coalesce("root", "node").alias("root"))
    roots = materialize(roots, "shingle-roots")
    left = links_left(members, roots.select("node", "root"), firsts, texts, small_bucket, block_shingles, dense)
    if left is not None:
        above = connected_components(left).toDF("root", "above")
        roots = roots.join(above, "root", "left").select("node", "o", F.coalesce("above", "root").alias("root"))
    kept = roots.groupBy("root").agg(F.min("o").alias("o")).select("o.row")
    return held.join(kept, "row", "left_semi").select(*[F.col(f"c{k}") for k in range(len(names))]).toDF(*names)
