"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditions.

Each rule is a conjunction of thresholds on per-text statistics. It is grown on
one part of the labelled rows, one literal at a time by information gain, and
pruned on the rest; the rows it covers leave, and the next rule is learned from
what remains. A rule must be right on nearly all rows it covers, so that texts
no rule is sure of are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import numbered, pick
from loomwork.llm.text_stats import text_stats

#: Labelled rows that rules are learned from at most: those of the least hash of their id.
MAX_LABELLED = 20_000

#: What literals may test: ratios of the counts, each guarded for texts without words.
MEASURES = {
    "n_words": "double(n_words)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "n_dup_lines": "double(n_dup_lines)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Literal:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] > self.threshold if self.above else x[self.measure] <= self.threshold


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    precision: float

    def column(self) -> Column:
        found = self.literals[0].column()
        for literal in self.literals[1:]:
            found = found & literal.column()
        return found

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([literal.holds(x) for literal in self.literals])


def _thresholds(values: np.ndarray, most: int = 64) -> np.ndarray:
    found = np.unique(values)
    middles = (found[1:] + found[:-1]) / 2
    return middles if len(middles) <= most else np.unique(np.quantile(middles, np.linspace(0, 1, most)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Literal]:
    inside, found = np.ones(len(bad), dtype=bool), []
    while len(found) < most:
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not n0 or not p0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (0.0, None, None)
        for measure, values in x.items():
            for threshold in _thresholds(values[inside]):
                for above in (True, False):
                    literal = Literal(measure, above, float(threshold))
                    within = inside & literal.holds(x)
                    p = bad[within].sum()
                    if p:
                        gain = p * (math.log2(p / within.sum()) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, literal, within)
        if best[1] is None:
            break
        found.append(best[1])
        inside = best[2]
    return found


def _prune(literals: list[Literal], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Literal]:
    """The prefix of the literals with the best (right - wrong) / covered, the shorter of equals."""

    def worth(prefix: list[Literal]) -> float:
        covered = np.logical_and.reduce([literal.holds(x) for literal in prefix])
        return (2 * bad[covered].sum() - covered.sum()) / covered.sum() if covered.any() else -1.0

    return max((literals[:k] for k in range(1, len(literals) + 1)), key=lambda p: (round(worth(p), 12), -len(p)))


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_literals: int = 4, min_precision: float = 0.9, min_covered: int = 8) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows; every third row is held for pruning. No rule where none is sure enough."""
    bad = np.asarray(bad, dtype=bool)
    left = np.ones(len(bad), dtype=bool)
    hold = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & ~hold, left & hold
        literals = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_literals)
        if not literals:
            break
        literals = _prune(literals, {k: v[prune] for k, v in x.items()}, bad[prune])
        covered = left & np.logical_and.reduce([literal.holds(x) for literal in literals])
        checked = covered & hold
        right = int(bad[covered].sum())
        precision = right / max(int(covered.sum()), 1)
        if right < min_covered or precision < min_precision or (checked.any() and bad[checked].mean() < min_precision):
            break
        rules.append(Rule(tuple(literals), precision))
        left &= ~covered
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, bad) of at most ``most`` labelled documents, those of the least id hash.

    A document's label is the mean of its labels; one without an id or a label
    is left out. Rows that share an id all come; fit() learns from one of them.
    """
    picked = (
        pick(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return pick(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``most`` rows


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from the statistics of labelled documents; what reaches the driver is a row of counts for each."""
    counted = labelled_sample(docs, labels, most).select("doc_id", "bad", text_stats(F.col("text")).alias("s")).select("doc_id", "bad", "s.*")
    rows = counted.select("doc_id", F.struct("bad", *[F.expr(e).alias(n) for n, e in MEASURES.items()]).alias("x")).groupBy("doc_id").agg(F.min("x").alias("x")).select("doc_id", "x.*").toPandas()
    rows = rows.sort_values("doc_id")
    return learn_rules({n: rows[n].to_numpy(float) for n in MEASURES}, rows["bad"].to_numpy(bool))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, else null."""
    found = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        found = F.when(rules[k].column(), F.lit(k)).otherwise(found)
    return found


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id`` with the counts, ``base_failed``, ``rule`` (number of the learned rule that rejects, else null) and ``kept``.

    One row for each row of ``docs``, repeated ones included; other columns are
    not read. A null text has no words and so fails the base rules; very long
    texts are counted whole; an empty table gives no row.
    """
    counted = pick(docs, "doc_id", "text").select("doc_id", text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    judged = counted.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs``, all columns, that neither the base rules nor a learned rule rejects.

    Null and empty texts have no words and go, very long texts are counted
    whole, repeated rows stay or go together, an empty table stays so.
    """
    held, at = numbered(docs)
    own = held.columns
    held = held.withColumn("s", text_stats(F.col(at["text"]))).select(*own, "s.*")
    return held.filter(~base_failed() & verdict(rules).isNull()).select(*own).toDF(*docs.columns)
