"""Mining a table for relationships: classified columns, all tests with false-discovery control, drivers and model of a target, components."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import model, nodes, pairs, profile, regression, sufficient
from loomwork.operators.moments import summed
from loomwork.scratch import materialize, scratch

ALPHA, SEED = 0.05, 42
#: Effects from which a finding is strong, moderate or weak (fixed values).
STRENGTHS = ((0.5, "strong"), (0.3, "moderate"), (0.1, "weak"))
SHAPES = {
    "linear": "a straight line", "log-x": "a curve that flattens", "log-y": "exponential growth", "log-log": "a proportional change",
    "quadratic": "a curve that bends", "categorical": "averages that differ by level",
}


@dataclass
class Finding:
    kind: str
    title: str
    headline: str  # always an association, never a cause
    columns: list[str]
    effect: float
    effect_name: str
    p_value: float
    q_value: float
    n: int
    payload: dict[str, Any] = field(default_factory=dict)

    @property
    def strength(self) -> str:
        return next((name for least, name in STRENGTHS if self.effect >= least), "negligible")


@dataclass
class Scan:
    dataset: str
    target: str | None
    n_rows: int
    seed: int
    alpha: float
    sampled: bool
    roles: dict[str, tuple[str, str | None]]
    tests: list[pairs.PairTest]
    findings: list[Finding]
    rejected: list[Finding]
    drivers: list[regression.Fit] = field(default_factory=list)
    model: model.Model | None = None
    diagnostics: model.Diagnostics | None = None
    pca: model.Pca | None = None
    notes: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession, significant: bool = True) -> DataFrame:
        return findings_frame(spark, self.findings if significant else self.rejected)


FINDINGS = "kind string, title string, headline string, columns array<string>, effect double, effect_name string, strength string, p_value double, q_value double, n long, payload string"


def findings_frame(spark: SparkSession, findings: list[Finding]) -> DataFrame:
    return spark.createDataFrame([(f.kind, f.title, f.headline, f.columns, f.effect, f.effect_name, f.strength, f.p_value, f.q_value, f.n, json.dumps(f.payload, default=str)) for f in findings], FINDINGS)


def pair_finding(t: pairs.PairTest, q: float) -> Finding:
    if t.kind == "num-num":
        kind, title = "correlation", f"{t.a} and {t.b}"
        text = f"Where {t.a} is higher, {t.b} tends to be {'higher' if t.direction == 'positive' else 'lower'} (r = {t.statistic:+.2f}; {t.effect**2:.0%} of the variation is shared)."
    elif t.kind == "num-cat":
        kind, title = "group-difference", f"{t.a} by {t.b}"
        text = f"The average of {t.a} differs between the groups of {t.b}, which go with {t.effect:.0%} of its variation."
    else:
        kind, title = "association", f"{t.a} and {t.b}"
        text = f"{t.a} and {t.b} are not independent (Cramer's V = {t.effect:.2f})."
    return Finding(kind, title, text, [t.a, t.b], t.effect, t.effect_name, t.p_value, q, t.n, {"test": t.test, "statistic": t.statistic, "direction": t.direction, **t.detail})


def driver_findings(target: str, fits: list[regression.Fit]) -> list[Finding]:
    """The fits that explain over 1 %; they are a family of tests of their own."""
    out = []
    for f, q in zip(fits, pairs.benjamini_hochberg([f.p_value for f in fits])[0], strict=True):
        if math.isfinite(f.adj_r2) and f.adj_r2 > 0.01:
            text = f"{f.predictor} alone goes with {f.adj_r2:.0%} of the variation of {target}: {SHAPES[f.form]} (adjusted R2 {f.adj_r2:.3f})."
            out.append(Finding("driver", f"{f.predictor} for {target}", text, [f.predictor, target], max(0.0, min(1.0, f.adj_r2)), "adjusted R2", f.p_value, q, f.n, asdict(f)))
    return out


def model_finding(m: model.Model) -> Finding:
    first = sorted(m.std_coefficients, key=lambda c: -abs(m.std_coefficients[c]))[:3]
    text = f"Together {len(m.predictors)} column(s) go with {m.adj_r2:.0%} of the variation of {m.target} (adjusted R2 {m.adj_r2:.3f}), most of all {', '.join(first)}."
    return Finding("model", f"Model of {m.target}", text, list(m.predictors), max(0.0, min(1.0, m.adj_r2)), "adjusted R2", m.p_value, m.p_value, m.n, asdict(m))


def tests_of(s: sufficient.Statistics) -> list[pairs.PairTest]:
    """The tests of pairs.all_pairs() from statistics: Pearson with rho, ANOVA, chi-square, in column order."""
    numeric, categorical = s.of.numeric, list(s.of.levels)
    k = len(numeric)
    found = [(a, b, n, r) for a in range(k) for b in range(a + 1, k) for n, r in [s.pairs.correlation(a, b)] if n >= pairs.LEAST_PAIRS and r is not None]
    tests = pairs.pearson_of(numeric, found, pairs.spearman_of(s.of.df, s.of.names, s.pairs.n, [(a, b) for a, b, _, _ in found]) if found else {})
    for x, name in enumerate(numeric):
        for c in categorical:
            groups = [g for g in groups_of(s, name, c) if g.n >= pairs.LEAST_GROUP]
            n = sum(g.n for g in groups)
            if not n:
                continue
            grand = sum(g.n * g.mean for g in groups) / n
            squares = sum(g.n * (g.mean - s.of.center[x]) ** 2 for g in groups)
            between = sum(g.n * (g.mean - grand) ** 2 for g in groups)
            tests.append(pairs.anova_of(name, c, len(groups), n, between if between > 1e-14 * squares else 0.0, sum(g.m2 for g in groups), {g.level: {"n": g.n, "mean": g.mean} for g in groups}))
    for i, a in enumerate(categorical):
        for b in categorical[i + 1 :]:
            cells = s.cells[np.ix_(s.places[a], s.places[b])]
            cells = cells[cells.sum(axis=1) > 0][:, cells.sum(axis=0) > 0]
            if min(cells.shape) >= 2:
                expected = np.outer(cells.sum(axis=1), cells.sum(axis=0)) / cells.sum()
                tests.append(pairs.chi_square_of(a, b, *cells.shape, int(cells.sum()), float(((cells - expected) ** 2 / expected).sum()), float(np.abs(cells - expected).max()), float((1 / expected).sum())))
    at = {c: k for k, c in enumerate([*numeric, *categorical])}
    return sorted((t for t in tests if t), key=lambda t: (at[t.a], at[t.b]))


def groups_of(s: sufficient.Statistics, value: str, group: str) -> list[pairs.Group]:
    """Moments of a number in each level of a category that has any, in text order."""
    x, out = s.of.numeric.index(value), []
    for level, k in zip(s.of.levels[group], s.places[group], strict=True):
        if n := int(s.n[k, x]):
            mean = s.sums[k, x] / n
            m2 = s.squares[k, x] - n * mean * mean
            out.append(pairs.Group(level, n, float(mean + s.of.center[x]), float(m2) if m2 > 1e-14 * s.squares[k, x] else 0.0))
    return out


def models_of(s: sufficient.Statistics, target: str) -> tuple[list[regression.Fit], model.Model | None, model.Diagnostics | None]:
    """Drivers, the stepwise model and its diagnostics; residuals of both kinds are one more pass over the written columns."""
    numeric, levels, t = s.of.numeric, s.of.levels, s.of.numeric.index(target)
    others = [k for k in range(len(numeric)) if k != t]
    fits, back = regression.ladder_of(regression.Ladder(s.ladder[:, others, :], s.of.center[[*others, t]], s.of.scale[[*others, t]]), target, [numeric[k] for k in others])
    fits += [f for c in levels if (f := regression.categorical_of(target, c, groups_of(s, target, c)))]
    # Candidates as places among numbers and levels: all numbers but the target, all levels but each first.
    dummies = [(f"{c}_{level}", len(numeric) + k) for c in levels for level, k in list(zip(levels[c], s.places[c], strict=True))[1:]]
    names, places = [numeric[k] for k in others] + [n for n, _ in dummies], others + [k for _, k in dummies]
    made = model.model_of(s.gram.only([*places, t]), names, target)
    rest = model.Residuals(*s.gram.only([places[names.index(p)] for p in made.predictors] + [t]).total()) if made else None
    at = {c: k for k, c in enumerate(numeric)}
    picked = [places[names.index(p)] for p in made.predictors] if made else []
    level_of = [(c, i) for c, of in enumerate(levels.values()) for i in range(len(of))]
    width, k = len(back) + (rest.width if rest else 0), len(numeric)

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(width)
        for block in blocks:
            raw, codes = block[:, :k], block[:, k:-1]
            for i, (f, _) in enumerate(back):
                out[i] += regression.back_residual(raw[:, at[f.predictor]], raw[:, t], f.form, f.coefficients["intercept"], f.coefficients[f.predictor])
            if rest:
                whole = ~np.isnan(block[:, :-1]).any(axis=1)
                columns = [raw[whole, p] if p < k else (codes[whole, level_of[p - k][0]] == level_of[p - k][1]).astype(float) for p in [*picked, t]]
                out[len(back) :] += rest.of(np.stack(columns, axis=1))
        return out

    if not width:
        return regression.best_of(fits), None, None
    sums = summed(s.of.df.select(*s.of.inputs), task, width)[0]
    regression.settle(back, sums[: len(back)])
    return regression.best_of(fits), made, rest.judged(sums[len(back) :]) if rest else None


def scan(df: DataFrame, target: str | None = None, max_rows: int | None = None, seed: int = SEED, alpha: float = ALPHA, name: str = "dataset") -> Scan:
    """Everything about a table at once, over all rows or a seeded sample of ``max_rows``.

    The table is read three times: for summaries, for exact distinct counts
    where they matter, and to write the columns that are mined. These are read
    for all statistics at once, for ranks, and for residuals. Rows stay on the
    executors; the driver sees counts and moments, whose number depends on the
    columns and their levels only. An unusable target is a ValueError with the
    reason. A categorical target has no drivers and no model.
    """
    total = df.count() if max_rows is not None else None
    sampled = max_rows is not None and total > max_rows
    with scratch(df.sparkSession):
        held = profile.without_nan(materialize(nodes.sample(df, max_rows, seed), "scan-sample") if sampled else df)
        found = profile.summaries(held)
        total = total if total is not None else found[0].rows if found else 0
        roles = {c: (r, reason) for _, c, r, reason in profile.roles_of(df, found)}
        if target is not None and roles.get(target, ("excluded", None))[0] == "excluded":
            raise ValueError(f"{target!r} cannot be the target: {roles.get(target, (None, 'it is no column of this table'))[1]}")
        numeric = [c for c, (r, _) in roles.items() if r == "numeric"]
        summary = dict(zip(df.columns, found, strict=True))
        levels = {c: summary[c].values for c, (r, _) in roles.items() if r == "categorical"}
        s = sufficient.statistics(sufficient.columns_of(held, numeric, levels, [summary[c].mean for c in numeric], [summary[c].deviation for c in numeric]), target)
        tests = tests_of(s)
        q, keep = pairs.benjamini_hochberg([t.p_value for t in tests], alpha)
        told = [pair_finding(t, x) for t, x in zip(tests, q, strict=True)]
        out = Scan(name, target, total, seed, alpha, sampled, roles, tests, sorted((f for f, k in zip(told, keep, strict=True) if k), key=lambda f: -f.effect), sorted((f for f, k in zip(told, keep, strict=True) if not k), key=lambda f: f.q_value))
        if target in numeric:
            out.drivers, out.model, out.diagnostics = models_of(s, target)
            out.findings += driver_findings(target, out.drivers)
            if out.model:
                out.findings.append(model_finding(out.model))
        elif target is not None:
            out.notes.append(f"{target} is categorical: group differences only")
        out.pca = model.pca_of(s.complete, numeric) if len(numeric) >= 3 else None
        if sampled:
            out.notes.append(f"a sample of {max_rows:,} of {total:,} rows, seed {seed}")
        return out


def save_findings(spark: SparkSession, result: Scan, path: str, created_at: datetime | None = None) -> int:
    """Append the findings with their lineage to a Parquet table; how many were written."""
    lineage = {"dataset": F.lit(result.dataset), "target": F.lit(result.target).cast("string"), "seed": F.lit(result.seed), "created_at": F.lit(created_at or datetime.now(UTC))}
    result.frame(spark).withColumns(lineage).write.mode("append").parquet(path)
    return len(result.findings)
