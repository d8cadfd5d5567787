"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every window of every text.

Test items become windows of ``width`` words (a shorter item is one window).
Windows are made, and repeated ones dropped, in Spark. Their words get numbers,
a window becomes one 64-bit sum of products, and a text's windows are looked up
in a hash set of the sums, whole arrays at a time; each hit is verified word by
word. A set too large for one broadcast is cut by hash into blocks of bounded
bytes, each sent, used in a pass over the texts and destroyed; hits are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import materialize, numbered, pick, utf8

WIDTH = 13
#: Windows, and bytes of their words and item ids, in one broadcast block.
BLOCK_WINDOWS, BLOCK_BYTES = 1_000_000, 128_000_000
FACTOR = 0x9E3779B97F4A7C15

#: A-Z lower-cased; ASCII that is neither letter nor digit becomes a space; bytes of other characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class HashSet:
    """A set of distinct unsigned 64-bit keys with the place of each: open addressing, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(2 * len(keys), 2).bit_length())  # two to four slots for each key
        size = 1 << (64 - int(self.shift))
        self.last, self.keys, self.at = np.int64(size - 1), np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of keys that meet in a slot the last one written stays
            placed = self.at[slot] == left
            self.keys[slot[placed]] = keys[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(FACTOR)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those not in the set."""
        found, left, slot = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self._slots(keys)
        while len(left):
            at = self.at[slot]
            same = (at >= 0) & (self.keys[slot] == keys[left])
            found[left[same]] = at[same]
            more = (at >= 0) & ~same
            left, slot = left[more], (slot[more] + 1) & self.last
        return found


@dataclass
class Windows:
    """Distinct windows of one length: word numbers, and the windows of each sum (``order[first[k] : first[k + 1]]``)."""

    sums: HashSet
    order: np.ndarray
    first: np.ndarray
    ids: np.ndarray


@dataclass
class NgramSet:
    """Windows of test items, ready for lookup. ``windows`` of (words, item) may repeat; windows of the item None name none."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    by_length: dict[int, Windows] = field(default_factory=dict)
    #: The items of each window; window numbers run through the lengths.
    owners: list[tuple[int, ...]] = field(default_factory=list)

    @classmethod
    def build(cls, windows: list[tuple[tuple[bytes, ...], object]]) -> NgramSet:
        found, at = cls(), {}
        grouped: dict[tuple[bytes, ...], set[int]] = {}
        for words, item in windows:
            owners = grouped.setdefault(words, set())
            if item is not None:
                if item not in at:
                    at[item] = len(found.items)
                    found.items.append(item)
                owners.add(at[item])
        lengths: dict[int, list[tuple[bytes, ...]]] = {}
        for words in grouped:
            lengths.setdefault(len(words), []).append(words)
        for n, rows in lengths.items():
            number = found.numbers
            ids = np.array([[number.setdefault(w, len(number) + 1) for w in words] for words in rows], dtype=np.int32)
            sums = window_sums(ids.reshape(-1), n)[::n]
            order = np.argsort(sums, kind="stable")
            keys, first = np.unique(sums[order], return_index=True)
            found.by_length[n] = Windows(HashSet(keys), (order + len(found.owners)).astype(np.int32), np.append(first, len(order)).astype(np.int32), ids)
            found.owners += [tuple(grouped[words]) for words in rows]
        return found

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(every (start, length) whose words are those of a window, numbers of the windows)."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        found: list[tuple[int, int]] = []
        which: set[int] = set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        base = 0
        for n, held in self.by_length.items():
            starts = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else ()  # windows of known words only
            if len(starts):
                here = np.zeros(len(starts), dtype=np.uint64)
                for k in range(n):
                    here = here * np.uint64(FACTOR) + ids[starts + k].astype(np.uint64)
                at = held.sums.find(here)
                for j in np.flatnonzero(at >= 0):
                    own = ids[starts[j] : starts[j] + n]
                    # Windows of one sum are nearly always one window; as windows are distinct, one at most is that of the text.
                    for window in held.order[held.first[at[j]] : held.first[at[j] + 1]]:
                        if (held.ids[window - base] == own).all():
                            found.append((int(starts[j]), n))
                            which.add(int(window))
                            break
            base += len(held.ids)
        return found, which

    def items_of(self, which: set[int]) -> list[str]:
        """The sorted items of some windows."""
        return sorted({self.items[i] for i in set().union(*(self.owners[w] for w in which))})


def window_sums(ids: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit sum of products of each window of ``n`` ids, overflow included."""
    found = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        found = found * np.uint64(FACTOR) + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return found


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(words binary, item string): the distinct windows of each item, words joined by spaces; a null id is an item of no name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), utf8(batch.column("text")), strict=True):
                words = normal_words(text)
                starts = range(max(len(words) - width, 0) + 1) if words else range(0)
                for at in range(0, len(starts), 10_000):
                    part = [b" ".join(words[k : k + width]) for k in starts[at : at + 10_000]]
                    yield pa.record_batch({"words": pa.array(part, pa.binary()), "item": pa.array([item.as_py()] * len(part), pa.string())})

    return pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "words binary, item string").distinct()


def blocks_of(benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_WINDOWS) -> tuple[int, Iterator]:
    """(number of blocks, the blocks as broadcasts, each made when it is asked for).

    Windows are written once and cut by their hash; a block holds about
    ``most`` windows, or BLOCK_BYTES, at most, and only it is on the driver.
    """
    windows = materialize(item_windows(benchmark, width), "decontaminate-windows")
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).first()
    blocks = max(1, -(-n // most), -(-size // BLOCK_BYTES))
    send = benchmark.sparkSession.sparkContext.broadcast

    def made() -> Iterator:
        for k in range(blocks):
            part = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k)
            yield send(NgramSet.build([(tuple(bytes(r["words"]).split(b" ")), r["item"]) for r in part.collect()]))

    return blocks, made()


def _covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for start, n in sorted(spans):
        total += max(0, start + n - max(start, end))
        end = max(end, start + n)
    return total


HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,length:int>>"


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    found: list[dict[str, int]] = []
    for start, n in sorted(spans):
        if found and start <= found[-1]["start"] + found[-1]["length"]:
            found[-1]["length"] = max(found[-1]["length"], start + n - found[-1]["start"])
        else:
            found.append({"start": start, "length": n})
    return found


def _hits(block) -> Column:
    """Struct column of ``HITS`` for the text column, from one broadcast block."""

    @F.arrow_udf(HITS)
    def of(texts: pa.Array) -> pa.Array:
        grams, rows = block.value, []
        for text in utf8(texts):
            words = normal_words(text)
            spans, which = grams.spans(words)
            rows.append({"n_words": len(words), "n_hit": _covered(spans), "items": grams.items_of(which), "spans": _merged(spans)})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))]))

    return of


def _united(spans: Column) -> Column:
    @F.arrow_udf("long")
    def of(spans: pa.Array) -> pa.Array:
        return pa.array([_covered([(s["start"], s["length"]) for s in v or []]) for v in spans.to_pylist()], pa.int64())

    return of(spans)


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_WINDOWS, text: str = "text") -> DataFrame:
    """``docs`` with ``hits``: struct of n_words, n_hit, items (sorted ids), spans (in words).

    One block needs no shuffle. Beyond, the texts are written once with a row
    number, each pass writes the hits of its block by row, and a text's hits,
    no more than its windows and items, are brought together by row.
    """
    n, blocks = blocks_of(benchmark, width, most)
    if n == 1:
        return docs.withColumn("hits", _hits(next(blocks))(F.col(text)))
    held = materialize(docs.withColumn("hit_row", F.monotonically_increasing_id()), "decontaminate-texts")
    passes = []
    for block in blocks:
        passes.append(materialize(held.select("hit_row", _hits(block)(F.col(text)).alias("hits")), "decontaminate-hits"))
        block.destroy()
    merged = reduce(DataFrame.union, passes).groupBy("hit_row").agg(F.max("hits.n_words").alias("n"), F.flatten(F.collect_list("hits.spans")).alias("s"), F.flatten(F.collect_list("hits.items")).alias("i"))
    hits = F.struct(F.col("n").alias("n_words"), _united(F.col("s")).alias("n_hit"), F.array_sort(F.array_distinct("i")).alias("items"), F.col("s").alias("spans"))
    return held.join(merged.select("hit_row", hits.alias("hits")), "hit_row").drop("hit_row")


def contaminated(n_hit: Column, n_words: Column, per: int = 20) -> Column:
    return (n_hit > 0) & (per * n_hit >= n_words)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    Null and empty texts have no words and are clean; very long ones are
    scanned whole; repeated rows come back as often; other columns are not
    read; an empty benchmark hits nothing. The windows of a benchmark row with
    a null item_id are hit like any other and name no item.
    """
    found = with_hits(pick(docs, "doc_id", "text"), benchmark, width, most).select("doc_id", "hits.*")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def cut_out(text: bytes, spans: list[dict[str, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    flat, ends, at = text.translate(NORMAL), [], 0
    for word in flat.split():
        start = flat.index(word, at)
        at = start + len(word)
        ends.append((start, at))
    kept, last = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        kept.append(text[last : max(last, ends[s["start"]][0])])
        last = max(last, ends[s["start"] + s["length"] - 1][1])
    return b"".join([*kept, text[last:]]).decode()


def _without(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut_out(t, s) if s else t.decode() for t, s in zip(utf8(texts), spans.to_pylist(), strict=True)], pa.string())

    return of(text, spans)


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = WIDTH, most: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs``, all columns, without what the benchmark shares.

    mode "documents": contaminated rows go, all others stay as they are.
    mode "spans": every row stays; hit words and what stands between them are cut out of ``text``.
    Passages of a benchmark row with a null item_id go like any other. Null and
    empty texts share nothing and stay, very long texts are read whole, repeated
    rows stay or go together, an empty table stays so.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}: documents or spans")
    names, (held, at) = docs.columns, numbered(docs)
    text = at["text"]
    held = with_hits(held, benchmark, width, most, text)
    if mode == "documents":
        held = held.filter(~contaminated(F.col("hits.n_hit"), F.col("hits.n_words")))
    else:
        held = held.withColumn(text, F.when(F.size("hits.spans") > 0, _without(F.col(text), F.col("hits.spans"))).otherwise(F.col(text)))
    return held.select(*[f"c{k}" for k in range(len(names))]).toDF(*names)
