"""Hidden Markov language model over words, trained by Baum-Welch, scored by the scaled forward recursion.

Words emit through a bounded alphabet of classes: each of the most frequent
words is a class of its own, all others share classes by a hash of their
ending. A state emits a class, the class emits the word by its smoothed share
of the class's count. Start, transition and class tables are therefore of a
fixed size and are broadcast, while word counts stay a distributed table as
large as the vocabulary. Training: tasks compute expected counts over all
training texts, each from its first word to its end, and their sums make the
next tables. Forward states of long texts are saved every ``SAVE`` words and
those between computed again on the way back, so that memory stays small.
Scoring is exact over whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import LOWER_AZ, fold_of, materialize, pick, utf8

STATES = 8
ITERATIONS = 5
SAVE = 1_024  # words between two saved forward states of a training sequence
HOLD = 32_000_000  # words a training task holds, as two bytes each, so that texts of like length are computed together
OWN_CLASSES = 2_000  # words with a class of their own
ENDING_CLASSES = 512
DICTIONARY = 100_000  # frequent words, counted out in place; about 5 MB in each task
FOLDS = 10
SMOOTH = 0.1
END = OWN_CLASSES + ENDING_CLASSES
CLASSES = END + 1


def ending_class(word: bytes) -> int:
    return OWN_CLASSES + zlib.crc32(word[-3:]) % ENDING_CLASSES


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word binary, ending int, n long) of the words of ``texts.text``: summed in each task, then by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter) -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(held.keys(), pa.binary()), "ending": pa.array(map(ending_class, held.keys()), pa.int32()), "n": pa.array(held.values(), pa.int64())})

        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                held.update(text.translate(LOWER_AZ).split())
                if len(held) > flush:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    found = texts.select("text").mapInArrow(count, "word binary, ending int, n long")
    return found.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Lexicon:
    """What scoring a word takes, of bounded size: the dictionary and the totals of classes."""

    number: dict[bytes, int]
    cls: np.ndarray  # class of each dictionary word
    log_base: np.ndarray  # log10 of its smoothed share of all tokens
    log_within: np.ndarray  # log10 of its smoothed share of its class
    class_log: np.ndarray  # log10 of each ending class's smoothed total
    class_counts: np.ndarray  # training tokens of each class
    tokens: int
    total_log: float  # log10(tokens + SMOOTH * (distinct + 1))


def frequent(counts: DataFrame, most: int) -> list:
    """All words above a count, the least for which there are at most ``most`` such words; counts are cut by their logarithm."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:
        if (held := held + n) > most:
            break
        least = at
    return [] if least is None else counts.filter(level >= least).select("word", "ending", "n").collect()


def lexicon(counts: DataFrame, training_texts: int, dictionary: int = DICTIONARY) -> Lexicon:
    """The lexicon of a written count table; an end of text is one token for each training text."""
    top = sorted(((bytes(r["word"]), r["ending"], r["n"]) for r in frequent(counts, dictionary)), key=lambda r: (-r[2], r[0]))
    by_class = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        n[r["ending"]], v[r["ending"]] = r["n"], r["v"]
    words, distinct = int(n.sum()), int(v.sum())
    for k, (_, ending, c) in enumerate(top[:OWN_CLASSES]):
        n[ending] -= c
        v[ending] -= 1
        n[k], v[k] = c, 1
    n[END] = training_texts
    tokens = words + training_texts
    total_log = math.log10(tokens + SMOOTH * (distinct + bool(training_texts) + 1))
    class_log = np.log10(n + SMOOTH * (v + 1))
    cls = np.array([min(k, OWN_CLASSES) if k < OWN_CLASSES else ending for k, (_, ending, _) in enumerate(top)], dtype=np.int64)
    log_count = np.log10(np.array([c for *_, c in top], dtype=float) + SMOOTH)
    within = np.where(cls < OWN_CLASSES, 0.0, log_count - class_log[cls]) if top else np.zeros(0)
    return Lexicon({w: k for k, (w, *_) in enumerate(top)}, cls, log_count - total_log, within, class_log, n, tokens, total_log)


ENCODED = "row long, doc_id {id}, held_out boolean, n_tokens long, known long, base double, within double, classes binary, rare array<binary>, rare_n array<int>"


def encode(docs: DataFrame, sent) -> DataFrame:
    """Each text as class numbers, with sums over its dictionary words; other words are listed with their number.

    ``docs`` has row, doc_id, held_out, text; ``sent`` broadcasts the lexicon.
    A class's share of an unlisted word is left to the count table: ``within``
    holds the denominators already.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = sent.value
        get = lex.number.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, known, base, within, classes, rare, rare_n = [], [], [], [], [], [], []
                for text in utf8(part.column("text")):
                    words = text.translate(LOWER_AZ).split()
                    ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
                    out = np.append(lex.cls[ids] if len(lex.cls) else np.zeros(len(ids), np.int64), END)
                    missing = np.flatnonzero(ids < 0)
                    for k in missing:
                        out[k] = ending_class(words[k])
                    listed = ids[ids >= 0]
                    others = Counter(words[k] for k in missing)
                    n.append(len(words) + 1)
                    known.append(len(listed) + (lex.class_counts[END] > 0))
                    base.append(float(lex.log_base[listed].sum()) + math.log10(lex.class_counts[END] + SMOOTH) - lex.total_log)
                    within.append(float(lex.log_within[listed].sum() - lex.class_log[out[missing]].sum()))
                    classes.append(out.astype("<u2").tobytes())
                    rare.append(list(others))
                    rare_n.append(list(others.values()))
                yield pa.record_batch(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(within, pa.float64()), pa.array(classes, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int32()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "within", "classes", "rare", "rare_n"],
                )

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(code, ENCODED.format(id=kind))


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes

    @classmethod
    def initial(cls, class_counts: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
        """Class shares of the corpus, unsettled by seeded noise so that states can part; states are made to last."""
        share = (class_counts + SMOOTH) / (class_counts + SMOOTH).sum()
        emit = share * np.exp(np.random.default_rng(seed).normal(0, 0.5, (states, len(share))))
        even = np.full(states, 1 / states)
        return cls(even, np.full((states, states), 0.05 / max(states - 1, 1)) * (1 - np.eye(states)) + (0.95 if states > 1 else 1.0) * np.eye(states), emit / emit.sum(axis=1, keepdims=True))

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray, keep: float = 20.0) -> Hmm:
        """The tables of expected counts, smoothed: emissions towards the class shares of the corpus with weight ``keep``."""
        share = (class_counts + SMOOTH) / (class_counts + SMOOTH).sum()
        total = emit.sum(axis=1, keepdims=True)
        used = (total[:, 0] + 1) / (total + 1).sum()
        return Hmm((start + used) / (start.sum() + 1), (move + 1 / len(move)) / (move.sum(axis=1, keepdims=True) + 1), (emit + keep * share) / (total + keep))


def _expected(model: Hmm, codes: np.ndarray, lengths: np.ndarray, save: int = SAVE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of sequences ``codes`` (steps x sequences), longest first, and their log-likelihood.

    Exact whatever the lengths: ``save`` steps of all sequences and one state
    of each for every ``save`` steps are held at a time.
    """
    steps, k = len(codes), len(model.start)
    emit, move = model.emit.T.astype(np.float32), model.move.astype(np.float32)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than each step

    def forward(a: np.ndarray, lo: int, hi: int, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
        for t in range(lo, hi):
            n = active[t]
            a = (a[:n] @ move if t else a) * emit[codes[t, :n]]
            s = a.sum(axis=1)
            a /= s[:, None]
            alpha[t - lo, :n], scale[t - lo, :n] = a, s
        return a

    def room() -> tuple[np.ndarray, np.ndarray]:
        size = min(save, steps)
        return np.zeros((size, len(lengths), k), np.float32), np.ones((size, len(lengths)), np.float32)

    saved, loglik = [np.tile(model.start.astype(np.float32), (len(lengths), 1))], 0.0
    alpha, scale = room()
    for lo in range(0, steps, save):
        scale[:] = 1
        saved.append(forward(saved[-1], lo, min(lo + save, steps), alpha, scale))
        loglik += float(np.log(scale.astype(np.float64)).sum())
    moves, emissions, w = np.zeros((k, k)), np.zeros((k, model.emit.shape[1])), np.zeros((0, k), np.float32)
    for lo in reversed(range(0, steps, save)):
        hi = min(lo + save, steps)
        if hi < steps:  # the last stretch is still there
            forward(saved[lo // save], lo, hi, alpha, scale)
        for t in range(hi - 1, lo - 1, -1):
            n, ahead, at = active[t], len(w), t - lo
            moves += alpha[at, :ahead].T @ w
            beta = np.ones((n, k), np.float32)
            beta[:ahead] = w @ move.T
            w = emit[codes[t, :n]] * beta / scale[at, :n, None]
            alpha[at, :n] *= beta  # from here on what the state is worth, not the forward share
        held = np.arange(len(lengths)) < active[lo:hi, None]
        of, weight = codes[lo:hi][held], alpha[: hi - lo][held]
        emissions += np.stack([np.bincount(of, weight[:, j], minlength=model.emit.shape[1]) for j in range(k)])
    return alpha[0].sum(axis=0).astype(float), moves * model.move, emissions, loglik


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes as steps x sequences, lengths), longest first."""
    rows = sorted(rows, key=len, reverse=True)
    codes = np.zeros((len(rows[0]), len(rows)), dtype=np.uint16)
    for j, c in enumerate(rows):
        codes[: len(c), j] = c
    return codes, np.array([len(c) for c in rows])


def _alike(rows: list[np.ndarray], together: int = 1024, cells: int = 8_000_000) -> Iterator[list[np.ndarray]]:
    """The sequences in groups of like length: at most ``together`` of them, and steps x sequences at most ``cells`` unless alone."""
    rows = sorted(rows, key=len, reverse=True)
    while rows:
        n = min(together, max(1, cells // max(len(rows[0]), 1)))
        yield rows[:n]
        rows = rows[n:]


def baum_welch_step(coded: DataFrame, model: Hmm, class_counts: np.ndarray, hold: int = HOLD) -> tuple[Hmm, float]:
    """One iteration over all rows of ``coded.classes``, each one whole sequence: (next model, log-likelihood under ``model``).

    Each task sums its expected counts and sends one set of tables; the driver
    receives their sum, states x classes numbers.
    """
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Hmm = sent.value
        k = len(m.start)
        start, move, emit, loglik = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape), 0.0
        held: list[np.ndarray] = []
        words = 0

        def drain() -> None:
            nonlocal start, move, emit, loglik
            for group in _alike(held):
                a, b, c, d = _expected(m, *_padded(group))
                start, move, emit, loglik = start + a, move + b, emit + c, loglik + d
            held.clear()

        for batch in batches:
            for value in batch.column(0):
                held.append(np.frombuffer(value.as_py(), dtype="<u2"))
                words += len(held[-1])
                if words > hold:
                    drain()
                    words = 0
        drain()
        tables = [(0, 0, start), *((1, i, move[i]) for i in range(k)), *((2, i, emit[i]) for i in range(k)), (3, 0, np.array([loglik]))]
        yield pa.record_batch({"kind": pa.array([t[0] for t in tables], pa.int32()), "i": pa.array([t[1] for t in tables], pa.int32()), "x": pa.array([t[2].tolist() for t in tables], pa.list_(pa.float64()))})

    rows = coded.select("classes").mapInArrow(expect, "kind int, i int, x array<double>").select("kind", "i", F.posexplode("x").alias("j", "x")).groupBy("kind", "i", "j").agg(F.sum("x").alias("x")).collect()
    start, move, emit, loglik = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit), 0.0
    for r in rows:
        if r["kind"] == 3:
            loglik = r["x"]
        else:
            (start[None], move, emit)[r["kind"]][r["i"], r["j"]] = r["x"]
    sent.unpersist()
    return model.updated(start, move, emit, class_counts), loglik


def log10_forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the exact probability of each class sequence: the forward recursion, rescaled at every step."""
    found = np.zeros(len(sequences))
    order = sorted(range(len(sequences)), key=lambda j: -len(sequences[j]))
    emit = np.ascontiguousarray(model.emit.T)
    while order:
        # As many sequences at a time as a bounded table of steps x sequences holds; one of any length always fits.
        take = order[: max(1, 4_000_000 // max(len(sequences[order[0]]), 1))]
        order = order[len(take) :]
        codes, lengths = _padded([sequences[j] for j in take]) if len(sequences[take[0]]) else (np.zeros((0, 0), int), np.zeros(len(take), int))
        total, a = np.zeros(len(take)), np.tile(model.start, (len(take), 1))
        active = len(take)
        for t in range(len(codes)):
            while lengths[active - 1] <= t:
                active -= 1
            a = (a[:active] @ model.move if t else a[:active]) * emit[codes[t, :active]]
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:active] += np.log10(s)
        found[take] = total
    return found


def _forward(coded: DataFrame, sent) -> DataFrame:
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "within"]
    schema = coded.select(*names).schema.add("forward", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = log10_forward(sent.value, [np.frombuffer(v.as_py(), dtype="<u2") for v in batch.column("classes")])
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(found)], names=[*names, "forward"])

    return coded.select(*names, "classes").mapInArrow(score, schema)


def train(coded: DataFrame, class_counts: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Hmm, list[float]]:
    """(model, log-likelihood before each iteration) of the training rows of ``coded``."""
    model, course = Hmm.initial(class_counts, states), []
    for _ in range(iterations):
        model, loglik = baum_welch_step(coded, model, class_counts)
        course.append(loglik)
    return model, course


def score_documents(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Learns from rows whose id is in none of the held-out folds (crc32 of the
    id as text modulo 10 is not 0). Null and empty texts are one end token. A
    null id counts as the empty text, which is held out. Repeated rows come
    back, and are learned from, as often as they came. Very long texts are
    learned from and scored whole. With no training row every word is unknown.
    Other columns are not read.
    """
    spark = docs.sparkSession
    held = pick(docs, "doc_id", "text").select("doc_id", (fold_of("doc_id", FOLDS) == 0).alias("held_out"), "text")
    counts = materialize(word_counts(held.filter("not held_out")), "hmm-counts")
    lex = lexicon(counts, held.filter("not held_out").count(), dictionary)
    coded = materialize(encode(held.withColumn("row", F.monotonically_increasing_id()), spark.sparkContext.broadcast(lex)), "hmm-coded")
    model, _ = train(coded.filter("not held_out"), lex.class_counts, states, iterations)
    scored = _forward(coded, spark.sparkContext.broadcast(model))
    listed = coded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    rare = (
        listed.join(counts.select("word", "n"), "word", "left").groupBy("row")
        .agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("seen"), F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("logs"))
    )
    out = scored.join(rare, "row", "left")
    logs, k = F.coalesce("logs", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - k * F.lit(lex.total_log)).alias("base_score"), (F.col("forward") + F.col("within") + logs).alias("score"),
    )
