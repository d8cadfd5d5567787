"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Cyclic boosting visits the features in turn,
fits a shallow tree on one feature's bins to the current gradient and adds a
small step of it to that feature's lookup table; then the pairs of features
that explain most of what is left get two-dimensional tables the same way.
A text's score is the logistic of an intercept and one table entry for each
feature and pair: whole arrays of bins added up.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomwork.llm.shared import fold_of, numbered, pick, utf8
from loomwork.llm.text_stats import SPACES, duplicate_lines, histogram, repeated_words, word_ids

#: Labelled rows that the model is fitted on at most: those of the least hash of their id.
MAX_LABELLED = 20_000

FEATURES = (
    "log_words", "chars_per_word", "symbols", "digits", "upper", "punctuation", "pipes", "other_ascii", "high_bytes",
    "dup_lines", "repeat_share", "distinct_share", "same_next_share", "words_per_line", "log_longest_word", "spaces_per_word",
)


def features_of(text: bytes) -> list[float]:
    """``FEATURES`` of one text; all are defined, and mostly zero, for the empty text."""
    words, h = text.split(), histogram(text)
    ids = word_ids(words)
    n, size = max(len(words), 1), max(len(text), 1)
    ascii_other = h[33:127].sum() - h[48:58].sum() - h[65:91].sum() - h[97:123].sum()
    symbols = h[list(b"#*$%&<>@^~_=+\\{}[]")].sum()
    marks = h[list(b".,;:!?'\"-()/")].sum()
    chars = h.sum() - h[0x80:0xC0].sum() - h[list(SPACES)].sum()
    return [
        np.log1p(len(words)), chars / n, symbols / n, h[48:58].sum() / n, h[65:91].sum() / n, marks / n, h[124] / n, ascii_other / n, h[128:].sum() / size,
        duplicate_lines(text) / n, repeated_words(ids) / n, len(np.unique(ids)) / n, float((ids[1:] == ids[:-1]).sum()) / n, n / (h[10] + 1), np.log1p(max(map(len, words), default=0)), h[list(SPACES)].sum() / n,
    ]


def text_features(text: Column) -> Column:
    """``FEATURES`` as an array<double>; null is the empty text."""

    @arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([features_of(t) for t in utf8(texts)], pa.list_(pa.float64()))

    return of(text)


@dataclass(frozen=True)
class Model:
    """Bin edges and tables; a few hundred numbers for each feature and pair."""

    edges: tuple[np.ndarray, ...]
    intercept: float
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between values, by quantile and at most ``bins`` - 1; a value half the rows share keeps a bin of its own."""
    found = np.unique(values)
    middles = (found[1:] + found[:-1]) / 2
    if len(middles) < bins:
        return middles
    cuts = np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])
    at = np.unique(np.clip(np.searchsorted(middles, cuts), 0, len(middles) - 1))
    return middles[np.unique(np.append(at, [0, len(middles) - 1]))][: bins - 1]


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """(gain, bins to the left) of the best cut of a histogram; gain 0 where none has ``least`` weight on either side."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge), 0)
    if not len(gain) or gain.max() <= 1e-12:
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float, depth: int = 2) -> np.ndarray:
    """Leaf values for each bin of a tree of the given depth on one histogram."""
    gain, at = _cut(g, h, ridge, least) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), _leaf(g.sum(), h.sum(), ridge))
    return np.concatenate([_tree(g[:at], h[:at], ridge, least, depth - 1), _tree(g[at:], h[at:], ridge, least, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values of the best tree on a two-dimensional histogram that cuts one axis and then both halves of the other
    at one place: all pairs of cuts are tried at once, as a first cut alone may gain nothing."""
    gs, hs = (np.cumsum(np.cumsum(x, axis=0), axis=1) for x in (g, h))
    quarters = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    if min(g.shape) < 2:
        return np.full(g.shape, _leaf(g.sum(), h.sum(), ridge))
    parts = list(zip(quarters(gs), quarters(hs), strict=True))
    i, j = np.unravel_index(np.argmax(sum(a**2 / (b + ridge) for a, b in parts)), (g.shape[0] - 1, g.shape[1] - 1))
    leaf = [_leaf(a[i, j], b[i, j], ridge) for a, b in ((np.broadcast_to(a, (g.shape[0] - 1, g.shape[1] - 1)), np.broadcast_to(b, (g.shape[0] - 1, g.shape[1] - 1))) for a, b in parts)]
    found = np.empty(g.shape)
    found[: i + 1, : j + 1], found[: i + 1, j + 1 :], found[i + 1 :, : j + 1], found[i + 1 :, j + 1 :] = leaf
    return found


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 200, pair_rounds: int = 60, max_pairs: int = 6, rate: float = 0.1, ridge: float = 1.0, least: float = 2.0, patience: int = 20) -> Model:
    """Boost the tables on rows ``x`` (n x features) with labels ``y`` in 0..1; every tenth row decides when to stop.

    With no row or one class only, all tables are zero and the intercept is the
    smoothed share of label 1.
    """
    y = np.asarray(y, dtype=float)
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    edges = tuple(_edges(x[:, k], bins) for k in range(x.shape[1]))
    model = Model(edges, intercept, tuple(np.zeros(len(e) + 1) for e in edges), (), ())
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    held = np.arange(len(y)) % 10 == 9
    fit = ~held
    weight = np.where(fit, 1.0, 0.0)
    margin = np.full(len(y), intercept)

    def loss() -> float:
        rows = held if held.any() else fit
        return float(np.mean(np.logaddexp(0, margin[rows]) - y[rows] * margin[rows]))

    def boost(shapes: list[tuple[np.ndarray, tuple[int, ...]]], tables: list[np.ndarray], rounds: int) -> list[np.ndarray]:
        nonlocal margin
        best, kept, since = loss(), ([t.copy() for t in tables], margin.copy()), 0
        for _ in range(rounds):
            for k, (at, shape) in enumerate(shapes):
                p = 1 / (1 + np.exp(-margin))
                g = np.bincount(at, weight * (y - p), minlength=int(np.prod(shape))).reshape(shape)
                h = np.bincount(at, weight * p * (1 - p), minlength=int(np.prod(shape))).reshape(shape)
                step = rate * (_tree(g, h, ridge, least) if len(shape) == 1 else _pair_tree(g, h, ridge))
                tables[k] += step
                margin = margin + step.reshape(-1)[at]
            now = loss()
            if now < best - 1e-6:
                best, kept, since = now, ([t.copy() for t in tables], margin.copy()), 0
            elif (since := since + 1) >= patience:
                break
        margin = kept[1]
        return kept[0]

    tables = boost([(b[:, k], (len(t),)) for k, t in enumerate(model.tables)], [t.copy() for t in model.tables], rounds)
    p = 1 / (1 + np.exp(-margin))
    worth = {}
    for i, j in combinations(range(x.shape[1]), 2):
        shape = (len(edges[i]) + 1, len(edges[j]) + 1)
        at = b[:, i] * shape[1] + b[:, j]
        g = np.bincount(at, weight * (y - p), minlength=shape[0] * shape[1]).reshape(shape)
        h = np.bincount(at, weight * p * (1 - p), minlength=shape[0] * shape[1]).reshape(shape)
        step = _pair_tree(g, h, ridge)
        worth[i, j] = float((2 * g * step - h * step**2).sum())
    pairs = tuple(sorted(sorted(worth, key=lambda ij: (-worth[ij], ij))[:max_pairs]))
    shapes = [(b[:, i] * (len(edges[j]) + 1) + b[:, j], (len(edges[i]) + 1, len(edges[j]) + 1)) for i, j in pairs]
    pair_tables = boost(shapes, [np.zeros(s) for _, s in shapes], pair_rounds)
    return Model(edges, intercept, tuple(tables), pairs, tuple(pair_tables))


def learning_fold(id_column: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32 of the id modulo 3 is not 1."""
    return fold_of(id_column, 3) != 1


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, label: str = "quality") -> Model:
    """Fit on at most ``most`` labelled documents of the learning fold; their features, not their texts, reach the driver.

    A document's label is the mean of its labels; rows without an id or a label
    are left out; of rows that share an id one is learned from.
    """
    picked = (
        pick(labels, "doc_id", label).dropna().filter(learning_fold()).groupBy("doc_id").agg(F.avg(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = pick(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.struct("y", text_features(F.col("text")).alias("x")).alias("r"))  # at most ``most`` rows are sent
    found = rows.groupBy("doc_id").agg(F.min("r").alias("r")).orderBy("doc_id").select("r.y", "r.x").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return train(x, found["y"].to_numpy(float))


def score(text: Column, model: Model) -> Column:
    """P(label 1) of a text column, 0 to 1; null is scored as the empty text."""

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        x = np.array([features_of(t) for t in utf8(texts)], dtype=float).reshape(-1, len(FEATURES))
        return pa.array(model.score(x))

    return of(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; no other column is read).

    Repeated rows come back as often; a null id is in no held-out fold; a null
    text scores as the empty one; very long texts are read whole; an empty
    table gives no row.
    """
    scored = pick(docs, "doc_id", "text").select("doc_id", (~learning_fold()).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model takes for label 1.

    A null or empty text is judged by its score as any other, very long texts
    are read whole, repeated rows stay or go together, an empty table stays so.
    """
    held, at = numbered(docs)
    return held.withColumn("s", score(F.col(at["text"]), model)).filter("s >= 0.5").drop("s").toDF(*docs.columns)
