"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingle hashes have
it. Two fingerprints link when they differ in at most ``radius`` bits. The 64
bits are cut into partitions, correlated bits together, and partition i gets a
threshold t_i with sum(t_i) = radius - partitions + 1: a linked pair then
differs in at most t_i bits of some partition i. A dynamic programme picks the
thresholds, and with them the number of partitions, that cost least by
candidate counts measured on all fingerprints. Probes enumerate the keys
within t_i of a partition's bits; candidates are verified on all 64 bits.
Equal fingerprints are one node, so a group of exact copies costs one row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomwork.llm.components import connected_components
from loomwork.llm.shared import LOWER_AZ, materialize, numbered, pick, utf8

BITS = 64
#: A (partition, key) bucket of more index x probe pairs than this goes the way that emits no pairs.
BUCKET_PAIRS = 1 << 22


def fingerprint_of(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; no words give zero."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(width)), strict=False))
        n = len(words) - width + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_digest
    # 255 hashes at a time fit their bit sums in a byte; blocks of 4,080 bound the memory of very long texts.
    while block := [digest(s, seed) for s in itertools.islice(shingles, 4080)]:
        bits = np.unpackbits(np.frombuffer(b"".join(block), dtype=np.uint8).reshape(-1, 8), axis=1)
        for at in range(0, len(block), 255):
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """Fingerprint column (a signed long with the unsigned value's bits); null and word-less texts give 0."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t, width, seed) for t in utf8(texts)), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64))

    return of(text)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits set together), over all rows of ``prints.fp``.

    Tasks send one row of sums for each bit; what reaches the driver is 64 x 64 numbers.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, together = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), 65536):
                bits = np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                together += bits.T @ bits
                n += len(bits)
        if n:
            yield pa.record_batch({"bit": pa.array(range(BITS + 1), pa.int32()), "sums": pa.array([*together.tolist(), [float(n)] + [0.0] * (BITS - 1)], pa.list_(pa.float64()))})

    rows = (
        prints.select("fp").mapInArrow(sums, "bit int, sums array<double>")
        .select("bit", F.posexplode("sums").alias("other", "n")).groupBy("bit", "other").agg(F.sum("n").alias("n")).collect()
    )
    found = np.zeros((BITS + 1, BITS))
    for r in rows:
        found[r["bit"], r["other"]] = r["n"]
    return int(found[BITS, 0]), found[:BITS]


def partition_bits(n: int, together: np.ndarray, partitions: int) -> list[int]:
    """Masks of ``partitions`` groups of bits of nearly equal number; each group takes the free bits most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, masks = set(range(BITS)), []
    for g in range(partitions):
        size = len(free) // (partitions - g)
        group = [max(free, key=lambda b: (sum(corr[b, c] for c in free), -b))]
        free.remove(group[0])
        while len(group) < size:
            b = max(free, key=lambda b: (sum(corr[b, c] for c in group), -b))
            free.remove(b)
            group.append(b)
        masks.append(sum(1 << b for b in group))
    return masks


def _within(q: list[float], t: int) -> list[float]:
    """P(at most k differences) for k = 0..t, of independent differences with probabilities q."""
    p = [1.0] + [0.0] * t
    for x in q:
        for k in range(t, -1, -1):
            p[k] = p[k] * (1 - x) + (p[k - 1] * x if k else 0)
    return list(itertools.accumulate(p))


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum radius - len(costs) + 1 of least summed ``costs[i][t_i + 1]``, by dynamic programming."""
    spare = radius + 1  # sum(t_i + 1)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, picks) in best.items():
            for up in range(min(len(cost) - 1, spare - used) + 1):
                total = so_far + cost[up]
                if used + up not in step or total < step[used + up][0]:
                    step[used + up] = (total, [*picks, up - 1])
        best = step
    return best[spare]


def plan_partitions(prints: DataFrame, radius: int, choices: tuple[int, ...] = (1, 2, 3, 4)) -> list[tuple[int, int]]:
    """[(bit mask, threshold)] of least estimated cost; collisions are counted on all fingerprints for each mask tried."""
    n, together = bit_statistics(prints)
    tried = {m: partition_bits(n, together, m) for m in choices}
    masks = sorted({mask for group in tried.values() for mask in group})
    keys = prints.select(F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks])).alias("x"))
    collisions = {
        r["mask"] % (1 << BITS): float(r["pairs"])
        for r in keys.groupBy("x.mask", "x.key").count().groupBy("mask").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    }
    p = np.diag(together) / max(n, 1)
    differs = 2 * p * (1 - p)
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for group in tried.values():
        costs = []
        for mask in group:
            q = [differs[b] for b in range(BITS) if mask >> b & 1]
            near, width = _within(q, radius), len(q)
            cost = [0.0]
            for t in range(radius + 1):
                probes = sum(math.comb(width, k) for k in range(t + 1))
                cost.append(n * (1 + probes) + collisions.get(mask, 0.0) * near[t] / max(near[0], 1e-300))
            costs.append(cost)
        cost, thresholds = allocate(costs, radius)
        if cost < best[0]:
            best = (cost, [(m, t) for m, t in zip(group, thresholds, strict=True) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _flips(mask: int, most: int) -> list[int]:
    bits = [_signed(1 << b) for b in range(BITS) if mask >> b & 1]
    found = [0]
    for k in range(1, most + 1):
        for pick in itertools.combinations(bits, k):
            x = 0
            for b in pick:
                x ^= b
            found.append(x)
    return found


def _keyed(prints: DataFrame, plan: list[tuple[int, int]], probes: bool) -> DataFrame:
    """(part, key, fp): the key of each partition, or every key within its threshold."""
    def keys(part: int, mask: int, flips: list[int]) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).alias("key")))

    parts = [keys(k, mask, _flips(mask, t if probes else 0)) for k, (mask, t) in enumerate(plan)]
    return prints.select("fp", F.explode(F.concat(*parts)).alias("x")).select("x.part", "x.key", "fp")


def _through_centres(prints: DataFrame, radius: int) -> DataFrame:
    """Edges that connect what all links of at most ``radius`` bits among ``prints`` connect, with no pair of them emitted.

    Fingerprints link exactly if a centre within radius // 2 of one is within
    the rest of the other, so each fingerprint names all centres around it and
    every centre ties those that named it to one of them: rows grow with the
    number of fingerprints only. For an odd radius the two sides differ.
    """
    near, far = radius // 2, radius - radius // 2
    everywhere = (1 << BITS) - 1
    named = lambda r: prints.select("fp", F.explode(F.array(*[F.lit(x) for x in _flips(everywhere, r)])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("centre"))
    if near == far:
        held = named(near)
        least = held.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
        return held.join(least, "centre").select(F.col("fp").alias("u"), "v").filter("u != v")
    inner = named(near).withColumnRenamed("fp", "u")
    outer = named(far).groupBy("centre").agg(F.min("fp").alias("v"))
    tied = inner.join(outer, "centre")
    # A centre's outer ring is tied together only where some fingerprint is inside; all of the ring then links to that one.
    ring = named(far).join(named(near).select("centre", F.col("fp").alias("v")).groupBy("centre").agg(F.min("v").alias("v")), "centre")
    return tied.select("u", "v").union(ring.select(F.col("fp").alias("u"), "v")).filter("u != v")


def links(prints: DataFrame, radius: int = 2, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``prints.fp`` whose components are those of all links within ``radius``.

    Buckets of up to ``bucket_pairs`` pairs are probed and verified; the
    fingerprints of larger ones are linked through centres, so no bucket is
    capped. Give distinct rows, read from storage.
    """
    plan = plan_partitions(prints, radius)
    index, probe = _keyed(prints, plan, False), _keyed(prints, plan, True)
    counts = (
        index.select("part", "key", F.lit(1).alias("i"), F.lit(0).alias("p")).union(probe.select("part", "key", F.lit(0).alias("i"), F.lit(1).alias("p")))
        .groupBy("part", "key").agg(F.sum("i").alias("i"), F.sum("p").alias("p"))
    )
    hot = materialize(counts.filter(F.col("i") * F.col("p") > bucket_pairs).select("part", "key"), "simhash-hot")
    some_hot = not hot.isEmpty()
    if some_hot:
        crowded = index.join(hot, ["part", "key"], "left_semi").select("fp").union(probe.join(hot, ["part", "key"], "left_semi").select("fp")).distinct()
        index, probe = index.join(hot, ["part", "key"], "left_anti"), probe.join(hot, ["part", "key"], "left_anti")
    pairs = (
        index.withColumnRenamed("fp", "u").join(probe.withColumnRenamed("fp", "v"), ["part", "key"])
        .filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v")
    )
    return pairs.union(_through_centres(crowded, radius)) if some_hot else pairs


def components_of(prints: DataFrame, radius: int = 2, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of ``prints`` (fp, id): the least id of its component, nulls aside."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = distinct.join(connected_components(links(distinct.select("fp"), radius, bucket_pairs)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = materialize(roots, "simhash-roots")
    return roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text; other columns are not read).

    Null and word-less texts have fingerprint zero and link like any other;
    very long texts are read whole.
    Repeated rows come back as often as they came. A row with a null doc_id is
    in its component but names none; a component of such rows only has a null
    component_id. An empty table gives no rows.
    """
    prints = materialize(pick(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), fingerprint(F.col("text"), width).alias("fp")), "simhash-prints")
    found = prints.join(components_of(prints, radius, bucket_pairs), "fp", "left")
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the least doc_id (null ids last), of equals any one.

    Other columns pass through whatever their names; rows get an id of their
    own in a written copy, so that repeated rows are told apart.
    """
    names, (held, at) = docs.columns, numbered(docs)
    held = materialize(held.withColumns({"row": F.monotonically_increasing_id(), "fp": fingerprint(F.col(at["text"]), width)}), "simhash-docs")
    prints = held.select(F.col(at["doc_id"]).alias("id"), "fp", "row")
    found = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("row"))).alias("id"))
    kept = components_of(found.select("fp", "id"), radius).select("component_id.row")
    return held.join(kept, "row", "left_semi").select(*[F.col(f"c{k}") for k in range(len(names))]).toDF(*names)
