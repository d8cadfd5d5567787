"""Divergence of sources: how differently the sources of a language use its terms, from count-level bitmaps.

A group is a (lang, source). For each group and each count c above zero, a
bitset holds the terms that occur c times in the group. The bitsets of two
groups, ANDed and popcounted, say how many terms have count c in one and d in
the other; counts of zero follow by complement. A pair's divergence is the sum
of these joint cells times f(p(c), p(d)): no term is looked at by itself.

Terms are dealt into blocks of about ``BLOCK`` terms of like frequency, as
terms of like frequency have few distinct counts; a task holds the bitsets of
one block, for two tiles of ``TILE`` sources at most.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import materialize, pick, utf8

#: A kept term is in so many documents of its language at least; added to counts; ranks of the ``term`` part.
LEAST_DOCS, ADDED, TOP, SCALE = 10, 2, 10, 1_000_000_000
#: Terms of a block; sources of a tile; distinct (group, term) a task holds before it passes its counts on.
BLOCK, TILE, HELD = 1_024, 64, 700_000

DOCUMENTS = (1 << 40) - 1
#: A-Z lower-cased; all ASCII that is no letter parts terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it) of ``docs`` (text, lang, source), nulls as empty texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], dict[bytes, int]] = defaultdict(dict)  # occurrences * 2**40 + documents
        size = 0

        def emptied() -> pa.RecordBatch:
            size = sum(map(len, held.values()))
            texts = lambda values: pa.array(values, pa.binary(), size=size).cast(pa.string())
            pairs = np.fromiter((n >> 40 for of in held.values() for n in of.values()), np.int64, size), np.fromiter((n & DOCUMENTS for of in held.values() for n in of.values()), np.int64, size)
            lang, source = ([key[k] for key, of in held.items() for _ in of] for k in (0, 1))
            batch = pa.record_batch({"lang": texts(lang), "source": texts(source), "term": texts([t for of in held.values() for t in of]), "n": pairs[0], "docs": pairs[1]})
            held.clear()
            return batch

        for batch in batches:
            for text, lang, source in zip(*(utf8(batch[name]) for name in ("text", "lang", "source")), strict=True):
                of = held[lang, source]
                before, get = len(of), of.get
                for term, n in Counter(terms_of(text)).items():
                    of[term] = get(term, 0) + (n << 40) + 1
                size += len(of) - before
                if size >= HELD:
                    yield emptied()
                    size = 0
        yield emptied()

    told = pick(docs, "text", "lang", "source").select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    found = told.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(1e9 * (count + 2) / (total + 2 * terms)), exact: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", wide(count + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(terms) * F.lit(ADDED).cast("decimal(2,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are 10^9 + 1 at most, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def blocks(kept: DataFrame) -> DataFrame:
    """lang, term, total, band, slot, place, size of kept terms (lang, term, total): a block is (lang, band, slot), of terms whose totals have as many bits.

    ``place`` numbers a block's ``size`` terms from 0. Terms are dealt to the
    slots of a band by hash, so a block has ``BLOCK`` terms or somewhat more or less.
    """
    banded = kept.withColumn("band", F.length(F.bin("total")))
    # Written first, so that its size is known when the join is planned: a hot band's terms then stay where they are.
    slots = materialize(banded.groupBy("lang", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("slots")), "divergence-slots")
    dealt = banded.join(slots, ["lang", "band"]).withColumn("slot", F.pmod(F.xxhash64("term"), F.col("slots")))
    whole = Window.partitionBy("lang", "band", "slot")
    return dealt.withColumn("place", (F.row_number().over(whole.orderBy("term")) - 1).cast("int")).withColumn("size", F.count("*").over(whole).cast("int")).drop("slots")


def cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joint cells of two groups' bitsets (levels x words): how many terms each level of ``a`` shares with each of ``b``; a few levels at a time."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    step = max(1, 262_144 // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = np.bitwise_count(a[at : at + step, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def with_zeros(joint: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Joint cells with a first row and column for counts of zero, by complement: levels hold ``a`` and ``b`` terms of the block's ``size``."""
    out = np.empty((len(a) + 1, len(b) + 1), dtype=np.int64)
    out[1:, 1:] = joint
    out[1:, 0] = a - joint.sum(axis=1)
    out[0, 1:] = b - joint.sum(axis=0)
    out[0, 0] = size - out[1:, :].sum() - out[0, 1:].sum()
    return out


def divergence(p: np.ndarray, q: np.ndarray, joint: np.ndarray) -> int:
    """Sum of joint cells times floor((p - q)^2 / (p + q)); a few rows at a time."""
    total = 0
    step = max(1, 262_144 // len(q))
    for at in range(0, len(p), step):
        x = p[at : at + step, None]
        total += int((joint[at : at + step] * ((x - q) ** 2 // (x + q))).sum())
    return total


BITMAPS = "lang string, source string, index int, total long, terms long, band int, slot long, size int, count long, bits array<struct<word:int,bits:long>>"


def bitmaps(held: DataFrame, groups: DataFrame) -> DataFrame:
    """``BITMAPS``: for each block and group a row of ``count`` 0 without bits, and one for each count above zero with its terms' 64-bit words that are not empty.

    held: lang, source, n, band, slot, place, size of each kept term in each
    group. groups: lang, source, index, total, terms.
    """
    word = held.groupBy("lang", "source", "band", "slot", F.col("n").alias("count"), F.floor(F.col("place") / 64).cast("int").alias("word"))
    words = word.agg(F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"))
    levels = words.groupBy("lang", "source", "band", "slot", "count").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bits"))  # one block's words at most
    every = held.groupBy("lang", "band", "slot").agg(F.max("size").alias("size"))
    # A block's row for every group of its language, terms or none.
    of_lang = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "index", "total", "terms")).alias("g"))
    zero = every.join(of_lang, "lang").select("lang", "band", "slot", "size", F.explode("g").alias("g")).select("lang", "g.*", "band", "slot", "size", F.lit(0).cast("long").alias("count"))
    zero = zero.withColumn("bits", F.lit(None).cast("array<struct<word:int,bits:long>>"))
    above = levels.join(groups, ["lang", "source"]).withColumn("size", F.lit(0))
    names = [f.split(" ")[0] for f in BITMAPS.split(", ")]
    return zero.select(*names).unionByName(above.select(*names))


def pair_values(maps: DataFrame) -> DataFrame:
    """lang, i, j, value: the divergence of groups i < j of a language, over all its blocks."""

    def of_block(rows: pa.Table) -> pa.Table:
        lang, left, right = rows["lang"][0].as_py(), rows["left"][0].as_py(), rows["right"][0].as_py()
        size = max(rows["size"].to_pylist())
        width = (size + 63) // 64
        total: dict[int, tuple[int, int]] = {}
        levels: dict[int, list[tuple[int, list]]] = defaultdict(list)
        for index, n, terms, count, bits in zip(*(rows[c].to_pylist() for c in ("index", "total", "terms", "count", "bits")), strict=True):
            if count:
                levels[index].append((count, bits))
            else:
                total[index] = n, terms
        made = {}
        for index, (n, terms) in total.items():
            of = sorted(levels[index], key=lambda x: x[0])
            sets = np.zeros((len(of), width), dtype=np.uint64)
            for k, (_, bits) in enumerate(of):
                for b in bits:
                    sets[k, b["word"]] = b["bits"] & 0xFFFFFFFFFFFFFFFF
            p = np.array([1 + SCALE * (c + ADDED) // (n + ADDED * terms) for c in [0, *(c for c, _ in of)]], dtype=np.int64)
            made[index] = sets, np.bitwise_count(sets).sum(axis=1, dtype=np.int64), p
        found = []
        for i in sorted(made):
            for j in sorted(made):
                if i < j and i // TILE == left and j // TILE == right:
                    (a, na, p), (b, nb, q) = made[i], made[j]
                    found.append((lang, i, j, divergence(p, q, with_zeros(cells(a, b), na, nb, size))))
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.table({"lang": pa.array(columns[0], pa.string()), "i": pa.array(columns[1], pa.int32()), "j": pa.array(columns[2], pa.int32()), "value": pa.array(columns[3], pa.int64())})

    # Each tile meets itself and every other one: a row goes to as many groups as its language has tiles.
    tile, last = F.floor(F.col("index") / TILE), F.floor((F.col("sources") - 1) / TILE)
    met = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda t: F.struct(F.least(t, tile).alias("left"), F.greatest(t, tile).alias("right")))
    tiled = maps.withColumn("t", F.explode(met)).select("*", "t.left", "t.right")
    parts = tiled.groupBy("lang", "band", "slot", "left", "right").applyInArrow(of_block, "lang string, i int, j int, value long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and by which terms from its language.

    Part ``pair`` has each other source of the language with the summed
    divergence over all kept terms; part ``term`` the ``top`` kept terms that
    the source uses more than its language does. Ranks count from 1 by falling
    value, then by item.

    Null text, lang and source are empty ones; every row of ``docs`` is a
    document, repeated rows each; very long texts are counted whole; a group
    without terms, or a language without kept terms, has pairs of that
    smoothing gives (0 without terms); a language of one source has no pair;
    an empty table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    counts = materialize(counted(docs), "divergence-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
    held = materialize(counts.select("lang", "source", "term", "n").join(blocks(kept), ["lang", "term"]), "divergence-terms")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    occurring = pick(docs, "lang", "source").select(empty("lang"), empty("source")).distinct()
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = held.groupBy("lang", "band", "slot").agg(F.max("size").alias("size")).groupBy("lang").agg(F.sum("size").alias("terms"))
    of_lang = Window.partitionBy("lang")
    groups = occurring.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms"])
    groups = groups.withColumn("index", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("int")).withColumn("sources", F.count("*").over(of_lang)).withColumn("lang_total", F.sum("total").over(of_lang))
    groups = materialize(groups, "divergence-groups")

    maps = materialize(bitmaps(held, groups.select("lang", "source", "index", "total", "terms")).join(groups.select("lang", "sources").distinct(), "lang"), "divergence-bitmaps")
    values = pair_values(maps)
    # Pairs of languages without kept terms have no block: their value is 0.
    others = groups.select("lang", "index", "source", "sources").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("sources") - 1).cast("int")))).filter("j != index")
    low, high = F.least("index", "j").alias("i"), F.greatest("index", "j").alias("j")
    pairs = others.select("lang", "source", F.col("j").alias("other"), low, high).join(values, ["lang", "i", "j"], "left")
    pairs = pairs.join(groups.select("lang", F.col("index").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    facts = groups.select("lang", "source", F.col("total").alias("group_total"), "lang_total", "terms")
    p, q = share(F.col("n"), F.col("group_total"), F.col("terms")), share(F.col("total"), F.col("lang_total"), F.col("terms"))
    used = held.join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = used.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    return ranked.unionByName(used).select("lang", "source", "part", "item", "value", "rank")
