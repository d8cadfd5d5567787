"""Multivariate regression, its checks and principal components, all from cross-products of one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.tails import chi2_tail, t_two_sided
from loomwork.operators.moments import FOLDS, Gram, complete, gram, summed
from loomwork.operators.nodes import quoted
from loomwork.operators.pairs import number
from loomwork.operators.regression import adjusted, model_p
from loomwork.scratch import materialize, scratch

LEAST_ROWS, MAX_PREDICTORS, HIGH_VIF = 20, 12, 10.0


@dataclass
class Model:
    target: str
    predictors: list[str]
    n: int
    r2: float
    adj_r2: float
    p_value: float
    bic: float
    coefficients: dict[str, float]
    p_values: dict[str, float]
    std_coefficients: dict[str, float]
    vif: dict[str, float] = field(default_factory=dict)
    weak: list[str] = field(default_factory=list)  # that a cross-validated lasso drops
    notes: list[str] = field(default_factory=list)


#: Levels of all categories together up to which cross-products of all of them are made at once; with more, those of levels are counted as they are picked.
DENSE_LEVELS = 1_000


def levels_of(df: DataFrame, categorical: Sequence[str], most: int) -> dict[str, list[str]] | None:
    """The levels of each category in text order; None if there are more than ``most`` in all."""
    if not categorical:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("string").alias("v")) for c in categorical])).alias("e")
    found = df.select(each).select("e.*").filter("v is not null").distinct().limit(most + 1).collect()
    if len(found) > most:
        return None
    out: dict[str, list[str]] = {c: [] for c in categorical}
    for r in sorted(found, key=lambda r: r["v"].encode()):
        out[r["c"]].append(r["v"])
    return out


def dummy(name: str, level: str) -> Column:
    """0 or 1, null where the column is."""
    return F.when(quoted(name).isNotNull(), (quoted(name).cast("string") == level).cast("double"))


def design(numeric: Sequence[str], levels: dict[str, list[str]]) -> dict[str, Column]:
    """Predictor columns: numbers, and 0/1 columns ``name_level`` for all levels but the first in text order.

    A dummy is null where its column is, so that complete rows are those of all candidates.
    """
    return {c: number(c) for c in numeric} | {f"{c}_{v}": dummy(c, v) for c, of in levels.items() for v in of[1:]}


def _bic(ssr: float, n: int, k: int) -> float:
    """k counts the intercept."""
    return n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + k * math.log(n)


def _ssr(s: np.ndarray, pick: Sequence[int], y: int) -> float:
    if not pick:
        return float(s[y, y])
    a, b = s[np.ix_(pick, pick)], s[pick, y]
    try:
        return float(max(s[y, y] - b @ np.linalg.solve(a, b), 0.0))
    except np.linalg.LinAlgError:
        return math.inf


def stepwise(s: np.ndarray, n: int, y: int, names: Sequence[str], most: int = MAX_PREDICTORS) -> list[int]:
    """Forward selection by BIC on centred cross-products, from the intercept alone until no addition lowers it; ties by name."""
    scale = np.sqrt(np.maximum(np.diag(s), 0))
    picked: list[int] = []
    best = _bic(s[y, y], n, 1)
    while len(picked) < most:
        options = []
        for j in range(len(names)):
            if j == y or j in picked or scale[j] == 0:
                continue
            trial = [*picked, j]
            corr = s[np.ix_(trial, trial)] / np.outer(scale[trial], scale[trial])
            if np.linalg.cond(corr) < 1e12:
                options.append((round(_bic(_ssr(s, trial, y), n, len(trial) + 1), 9), names[j], j))
        if not options or min(options)[0] >= best:
            break
        best, _, j = min(options)
        picked.append(j)
    return picked


def lasso(a: np.ndarray, b: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 1000) -> np.ndarray:
    """Coordinate descent for standardised predictors: ``a`` their correlations, ``b`` those with the target."""
    w = np.zeros(len(b)) if start is None else start.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            if a[j, j] <= 0:
                continue
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            new = math.copysign(max(abs(rho) - penalty, 0.0), rho) / a[j, j]
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        if moved < 1e-10:
            break
    return w


def lasso_dropped(g: Gram, pick: Sequence[int], y: int, names: Sequence[str], steps: int = 60) -> list[str]:
    """Predictors whose coefficient a lasso with the penalty of least cross-validated error sets to zero; folds are cross-products."""
    n, mean, s = g.total()
    scale = np.sqrt(np.diag(s)[pick] / n)
    b = s[pick, y] / n / scale
    path = np.geomspace(max(np.abs(b).max(), 1e-12), max(np.abs(b).max(), 1e-12) * 1e-3, steps)
    error = np.zeros(steps)
    for fold in range(len(g.n)):
        m, fm, fs = g.without(fold)
        if not g.n[fold] or m < 3:
            continue
        fa = fs[np.ix_(pick, pick)] / m / np.outer(scale, scale)
        fb = fs[pick, y] / m / scale
        # cross-products of the held fold about the training means
        d = g.sums[fold] / g.n[fold] + g.center - fm
        held = g.cross[fold] - np.outer(g.sums[fold], g.sums[fold]) / g.n[fold] + g.n[fold] * np.outer(d, d)
        w = None
        for k, penalty in enumerate(path):
            w = lasso(fa, fb, penalty, w)
            c = w / scale
            error[k] += held[y, y] - 2 * c @ held[pick, y] + c @ held[np.ix_(pick, pick)] @ c
    w = lasso(s[np.ix_(pick, pick)] / n / np.outer(scale, scale), b, path[int(np.argmin(error))])
    return [names[j] for j, x in zip(pick, w, strict=True) if abs(x) < 1e-6]


def solved(s: np.ndarray, mean: np.ndarray, n: int, pick: Sequence[int], y: int, names: Sequence[str], target: str) -> Model:
    """The least-squares model of the picked columns."""
    k = len(pick)
    a, b = s[np.ix_(pick, pick)], s[pick, y]
    inverse = np.linalg.inv(a)
    w = inverse @ b
    ssr = float(max(s[y, y] - b @ w, 0.0))
    r2 = float(max(0.0, min(1.0, 1 - ssr / s[y, y])))
    var = ssr / (n - k - 1)
    se = np.sqrt(np.maximum(var * np.diag(inverse), 0))
    intercept = float(mean[y] - w @ mean[pick])
    se0 = math.sqrt(max(var * (1 / n + mean[pick] @ inverse @ mean[pick]), 0))
    p = lambda x, e: t_two_sided(math.inf if e == 0 else float(x / e), n - k - 1)
    model = Model(
        target, [names[j] for j in pick], n, r2, adjusted(r2, n, k), model_p(r2, n, k), _bic(ssr, n, k + 1),
        {"intercept": intercept} | {names[j]: float(x) for j, x in zip(pick, w, strict=True)},
        {"intercept": p(intercept, se0)} | {names[j]: p(x, e) for j, x, e in zip(pick, w, se, strict=True)},
        {names[j]: float(x * math.sqrt(s[j, j] / s[y, y])) for j, x in zip(pick, w, strict=True)},
    )
    if k >= 2:
        scale = np.sqrt(np.diag(a))
        model.vif = {names[j]: float(v) for j, v in zip(pick, np.diag(np.linalg.inv(a / np.outer(scale, scale))), strict=True)}
        if high := [c for c, v in model.vif.items() if v > HIGH_VIF]:
            model.notes.append(f"predictors that say nearly the same as others (VIF over {HIGH_VIF:g}): {', '.join(high)}")
    return model


def fit_multivariate(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], most: int = MAX_PREDICTORS) -> tuple[Model, dict[str, Column]] | None:
    """The stepwise model over rows complete in all candidates, and the columns it is made of; None under 20 rows or without a predictor."""
    numeric, categorical = [c for c in numeric if c != target], [c for c in categorical if c != target]
    levels = levels_of(df, categorical, DENSE_LEVELS)
    if levels is None:
        return fit_many_levels(df, target, numeric, categorical, most)
    columns = design(numeric, levels)
    made = model_of(gram(df, [*columns.values(), number(target)], FOLDS), list(columns), target, most)
    return (made, columns) if made else None


def fit_many_levels(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], most: int = MAX_PREDICTORS) -> tuple[Model, dict[str, Column]] | None:
    """fit_multivariate() for categories of any number of levels: the same model, from sparse cross-products.

    Of a level only its rows, and its sums of numbers and target, are kept, as
    a row of a table. Each round that table tells, on the executors, by how
    much each level would lower the squares left, given what is picked; one row
    reaches the driver. When a level is picked, the rows that have it are
    counted by the levels of the other columns, and the table gets a number more.
    """
    with scratch(df.sparkSession):
        x, k = [f"x{i}" for i in range(len(numeric))], len(numeric)
        made = [*[number(c).alias(n) for n, c in zip(x, numeric, strict=True)], number(target).alias("y"), *[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)]]
        held = materialize(df.select(*made).dropna(), "model-rows")
        g = gram(held, [F.col(c) for c in [*x, "y"]], 1)
        n, mean, s = g.total()
        if n < LEAST_ROWS or s[k, k] <= 0:
            return None
        every = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in range(len(categorical))])).alias("e")
        shifted = [F.sum(F.col(c) - F.lit(float(m))).alias(f"s_{c}") for c, m in zip([*x, "y"], mean, strict=True)]
        table = held.select(*x, "y", every).groupBy("e.c", "e.v").agg(F.count("*").alias("n"), *shifted)
        first = table.groupBy("c").agg(F.min("v").alias("v"))
        names = F.element_at(F.array(*map(F.lit, categorical)), F.col("c") + 1)
        # cross: with what is picked, in its order
        table = materialize(table.join(F.broadcast(first), ["c", "v"], "left_anti").select("*", F.concat(names, F.lit("_"), F.col("v")).alias("name"), F.array().cast("array<double>").alias("cross")), "model-levels")
        picked: list[tuple[str, object]] = []  # (name, place among the numbers or (column, level))
        a, b = np.zeros((0, 0)), np.zeros(0)
        best = _bic(s[k, k], n, 1)
        while len(picked) < most:
            inverse = np.linalg.inv(a) if len(picked) else a
            left = float(s[k, k] - b @ inverse @ b)
            options = []
            for j in range(k):
                if s[j, j] > 0 and j not in [place for _, place in picked]:
                    cross = np.array([s[j, place] if isinstance(place, int) else place[2][j] for _, place in picked])
                    own, with_y = s[j, j] - cross @ inverse @ cross, s[j, k] - cross @ inverse @ b
                    if own > 1e-12 * s[j, j]:
                        options.append((left - with_y**2 / own, numeric[j], j, cross, s[j, j], s[j, k]))
            variance = F.col("n") - F.col("n") * F.col("n") / F.lit(float(n))
            dot = lambda w: F.aggregate(F.zip_with("cross", F.array(*[F.lit(float(v)) for v in w]).cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
            solved_cross = F.array(*[dot(row) for row in inverse]).cast("array<double>")
            quadratic = F.aggregate(F.zip_with("cross", solved_cross, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
            own, with_y = variance - quadratic, F.col("s_y") - dot(inverse @ b)
            done = [F.lit(name) for name, place in picked if not isinstance(place, int)]
            able = table.filter(~F.col("name").isin(done)) if done else table
            able = able.select("*", variance.alias("variance"), own.alias("own"), (F.lit(left) - with_y * with_y / own).alias("rest")).filter("variance > 0 and own > 1e-12 * variance")
            # Ties at 9 digits of the criterion are settled by name, as among numbers.
            scored = able.withColumn("bic", F.round(F.lit(n * (math.log(2 * math.pi) + 1) + (len(picked) + 2) * math.log(n)) + n * F.ln(F.greatest("rest", F.lit(1e-300)) / n), 9))
            if top := scored.orderBy("bic", "name").first():
                options.append((top["rest"], top["name"], top, np.array(top["cross"]), top["variance"], top["s_y"]))
            trials = [(round(_bic(max(rest, 0.0), n, len(picked) + 2), 9), name, place, cross, own, with_y) for rest, name, place, cross, own, with_y in options]
            if not trials or min(t[:2] for t in trials)[0] >= best:
                break
            best, name, place, cross, own, with_y = min(trials, key=lambda t: t[:2])
            a, b = np.block([[a, cross[:, None]], [cross[None, :], np.array([[own]])]]), np.append(b, with_y)
            if isinstance(place, int):
                table = table.withColumn("cross", F.array_append("cross", F.col(f"s_x{place}")))
                picked.append((name, place))
            else:
                both = held.filter(F.col(f"c{place['c']}") == place["v"]).select(every).groupBy("e.c", "e.v").agg(F.count("*").alias("both"))
                more = F.coalesce("both", F.lit(0)) - F.col("n") * F.lit(place["n"] / n)
                table = table.join(both, ["c", "v"], "left").withColumn("cross", F.array_append("cross", more)).drop("both")
                picked.append((name, (place["c"], place["v"], [place[f"s_{c}"] for c in x])))
            table = materialize(table, "model-levels")
        if not picked:
            return None
        columns = {name: number(numeric[place]) if isinstance(place, int) else dummy(categorical[place[0]], place[1]) for name, place in picked}
        own = [F.col(f"x{place}") if isinstance(place, int) else (F.col(f"c{place[0]}") == place[1]).cast("double") for _, place in picked]
        g = gram(held, [*own, F.col("y")], FOLDS)
    n, mean, s = g.total()
    pick, y = list(range(len(picked))), len(picked)
    model = solved(s, mean, n, pick, y, [*columns, target], target)
    model.weak = lasso_dropped(g, pick, y, [*columns, target])
    if model.weak:
        model.notes.append(f"a cross-validated lasso would drop: {', '.join(model.weak)}")
    # The other candidates say which rows are complete.
    rest = {c: number(c) for c in numeric if c not in columns} | {f"{c} is there": F.when(quoted(c).isNotNull(), F.lit(1.0)) for c in categorical}
    return model, columns | rest


def model_of(g: Gram, candidates: Sequence[str], target: str, most: int = MAX_PREDICTORS) -> Model | None:
    """The stepwise model from the cross-products of the candidates and, last, the target."""
    names = [*candidates, target]
    n, mean, s = g.total()
    y = len(names) - 1
    if n < LEAST_ROWS or not candidates or s[y, y] <= 0:
        return None
    pick = stepwise(s, n, y, names, most)
    if not pick:
        return None
    model = solved(s, mean, n, pick, y, names, target)
    model.weak = lasso_dropped(g, pick, y, names)
    if model.weak:
        model.notes.append(f"a cross-validated lasso would drop: {', '.join(model.weak)}")
    return model


@dataclass
class Diagnostics:
    n: int
    jarque_bera: float
    normality_p: float
    breusch_pagan: float
    spread_p: float
    influential: int
    problems: list[str]
    verdict: str


class Residuals:
    """Sums over the residuals of a model, block by block: made from the cross-products of its predictors and, last, its target."""

    def __init__(self, n: int, mean: np.ndarray, s: np.ndarray) -> None:
        k = len(mean) - 1
        self.n, self.k, self.mean, self.inverse = n, k, mean, np.linalg.inv(s[:k, :k])
        self.w = self.inverse @ s[:k, k]
        self.var = max(float(s[k, k] - s[:k, k] @ self.w), 0.0) / max(n - k - 1, 1)

    @property
    def width(self) -> int:
        return 6 + self.k

    def of(self, block: np.ndarray) -> np.ndarray:
        n, k = self.n, self.k
        x = block[:, :k] - self.mean[:k]
        e = block[:, k] - self.mean[k] - x @ self.w
        h = np.minimum(1 / n + np.einsum("ij,jk,ik->i", x, self.inverse, x), 1 - 1e-12)
        cook = e**2 / ((k + 1) * self.var) * h / (1 - h) ** 2 if self.var else np.zeros(len(e))
        return np.concatenate([[len(e), (e**2).sum(), (e**3).sum(), (e**4).sum(), (cook > 4 / n).sum(), e.sum()], (e**2) @ x])

    def judged(self, m: np.ndarray) -> Diagnostics:
        n = self.n
        m2, m3, m4 = m[1] / n, m[2] / n, m[3] / n
        jb = n / 6 * ((m3 / m2**1.5) ** 2 + (m4 / m2**2 - 3) ** 2 / 4) if m2 > 0 else 0.0
        spread = m[3] - n * m2**2
        bp = n * float(m[6:] @ self.inverse @ m[6:]) / spread if spread > 0 else 0.0
        jb, bp, strong = float(jb), float(bp), int(m[4])
        normal, even = chi2_tail(jb, 2), chi2_tail(bp, self.k)
        found = {"residuals are not normal": normal < 0.05, "their spread changes with the predictors": even < 0.05, "over 5% of rows have much influence": strong > 0.05 * n}
        problems = [text for text, holds in found.items() if holds]
        return Diagnostics(n, jb, normal, bp, even, strong, problems, ("good", "caution", "poor")[min(len(problems), 2)])


def diagnose(df: DataFrame, model: Model, columns: dict[str, Column]) -> Diagnostics:
    """Residual checks over the model's own rows: one pass for cross-products, one for residuals.

    Normality by Jarque-Bera at every size; spread by Breusch-Pagan; influence
    by Cook's distance over 4 / n, a problem where over 5 % of rows are.
    """
    everything = [*columns.values(), number(model.target)]
    at = [list(columns).index(p) for p in model.predictors]
    held = complete(df, everything).select(*[f"x{j}" for j in at], f"x{len(columns)}")
    rest = Residuals(*gram(held, [F.col(c) for c in held.columns], 1).total())
    return rest.judged(summed(held, lambda blocks: sum((rest.of(b) for b in blocks), np.zeros(rest.width)), rest.width)[0])


@dataclass
class Pca:
    columns: list[str]
    n: int
    explained: list[float]
    cumulative: list[float]
    loadings: list[dict[str, float]]
    drivers: list[list[str]]
    needed_for_90: int
    mean: np.ndarray
    scale: np.ndarray


def run_pca(df: DataFrame, numeric: Sequence[str], most: int = 8) -> Pca | None:
    """Principal components of standardised columns over complete rows; None under three varying columns or ten rows.

    Shares are of all components; a component's sign makes its largest loading positive.
    """
    return pca_of(gram(df, [number(c) for c in numeric], 1), numeric, most) if len(numeric) >= 3 else None


def pca_of(g: Gram, numeric: Sequence[str], most: int = 8) -> Pca | None:
    """Principal components from the columns' cross-products."""
    n, mean, s = g.total()
    varying = [k for k in range(len(numeric)) if s[k, k] > 0]
    if n < 10 or len(varying) < 3:
        return None
    names, scale = [numeric[k] for k in varying], np.sqrt(np.diag(s)[varying] / (n - 1))
    values, vectors = np.linalg.eigh(s[np.ix_(varying, varying)] / (n - 1) / np.outer(scale, scale))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(values))])
    share = values / values.sum()
    total = np.cumsum(share)
    kept = min(most, len(values))
    loadings = [dict(zip(names, map(float, vectors[:, k]), strict=True)) for k in range(kept)]
    drivers = [[c for c, x in sorted(part.items(), key=lambda kv: -abs(kv[1])) if abs(x) >= 0.35] for part in loadings]
    return Pca(names, n, share[:kept].tolist(), total[:kept].tolist(), loadings, drivers, int(np.searchsorted(total, 0.9 - 1e-12) + 1), mean[varying], scale)


def pca_scores(df: DataFrame, pca: Pca, components: int = 2) -> DataFrame:
    """``df`` with pc1, pc2, ...: plain column arithmetic; null where a column is."""
    standard = [(number(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(pca.columns, pca.mean, pca.scale, strict=True)]
    return df.withColumns({f"pc{k + 1}": sum((F.lit(pca.loadings[k][c]) * z for c, z in zip(pca.columns, standard, strict=True)), F.lit(0.0)) for k in range(min(components, len(pca.loadings)))})
