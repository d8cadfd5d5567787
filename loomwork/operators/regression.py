"""Single-predictor regressions: a ladder of forms for numbers, level means for categories."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.tails import f_tail
from loomwork.operators.moments import summed
from loomwork.operators.pairs import Group, group_moments, number

LEAST_ROWS = 12


@dataclass
class Fit:
    """``native_r2`` is on the scale the form is fitted on, ``r2`` and ``adj_r2`` on the original scale of the target."""

    predictor: str
    form: str
    n: int
    native_r2: float
    r2: float
    adj_r2: float
    p_value: float
    coefficients: dict[str, float]
    std_coefficient: float | None = None
    direction: str = ""
    equation: str = ""
    caveat: str = ""
    detail: dict = field(default_factory=dict)


def adjusted(r2: float, n: int, k: int) -> float:
    return 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else math.nan


def model_p(r2: float, n: int, k: int) -> float:
    if n <= k + 1:
        return math.nan
    return 0.0 if r2 >= 1 else f_tail(r2 / k / ((1 - r2) / (n - k - 1)), k, n - k - 1)


@dataclass
class Ladder:
    """Sums over the rows where predictor and target are there (``PREDICTOR`` x predictors x ``TARGET``): values less ``center``, powers in units of ``scale``."""

    sums: np.ndarray
    center: np.ndarray  # of the predictors, then of the target
    scale: np.ndarray


def ladder(df: DataFrame, target: str, predictors: Sequence[str]) -> list[Fit]:
    """All forms of all predictors: log forms only where every logged value is positive; three passes over the data in all.

    The first gives means, the second all sums, the third the residuals on the
    target's scale of the forms that log it.
    """
    names = [*predictors, target]
    held = df.select(*[number(c).alias(f"x{k}") for k, c in enumerate(names)])
    first = held.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in held.columns]).first()
    center = np.array([first[c]["m"] or 0.0 for c in held.columns])
    scale = np.array([first[c]["s"] or 1.0 for c in held.columns])
    found = ladder_sums(held, center, scale)
    fits, back = ladder_of(Ladder(found, center, scale), target, predictors)
    if back:
        at = {p: k for k, p in enumerate(predictors)}

        def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(len(back))
            for block in blocks:
                out += [back_residual(block[:, at[f.predictor]], block[:, -1], f.form, f.coefficients["intercept"], f.coefficients[f.predictor]) for f, _ in back]
            return out

        settle(back, summed(held, task, len(back))[0])
    return fits


def ladder_sums(held: DataFrame, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """``Ladder.sums`` of double columns, the target last: one pass."""
    logs = np.array([math.log(c) if c > 0 else 0.0 for c in center])
    shape = (8, len(center) - 1, 6)

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(shape)
        for raw in blocks:
            there = ~np.isnan(raw)
            one, x, positive = there.astype(float), np.where(there, raw - center, 0.0), there & (raw > 0)
            z, log = x / scale, np.where(positive, np.log(np.where(positive, raw, 1.0)) - logs, 0.0)
            y = np.stack([one[:, -1], x[:, -1], x[:, -1] ** 2, log[:, -1], log[:, -1] ** 2, positive[:, -1]], axis=1)
            out += np.stack([p[:, :-1].T @ y for p in (one, z, z**2, z**3, z**4, log, log**2, positive.astype(float))])
        return out.reshape(1, -1)

    found = summed(held, task, int(np.prod(shape)))
    return found.reshape(shape) if len(found) else np.zeros(shape)


def back_residual(x: np.ndarray, y: np.ndarray, form: str, a: float, b: float) -> float:
    """The squared residuals, on the scale of y, of a fit to ln(y)."""
    both = ~np.isnan(x) & ~np.isnan(y)
    return float(((np.exp(a + b * (x[both] if form == "log-y" else np.log(x[both]))) - y[both]) ** 2).sum())


def ladder_of(found: Ladder, target: str, predictors: Sequence[str]) -> tuple[list[Fit], list[tuple[Fit, float]]]:
    """(fits, those to ln(y) with the target's squares): the latter's R2 are settle()d by their residuals."""
    fits: list[Fit] = []
    back: list[tuple[Fit, float]] = []
    cy, sy = found.center[-1], found.scale[-1]
    ly = math.log(cy) if cy > 0 else 0.0
    for k, p in enumerate(predictors):
        s, cx, sx = found.sums[:, k, :], found.center[k], found.scale[k]
        one, z, z2, z3, z4, log, log2, positive = s
        n, lx = int(one[0]), math.log(cx) if cx > 0 else 0.0
        # (sum, squares, center, unit) of each side; (sum of products) by form
        left = {"x": (z[0], z2[0], cx, sx), "ln": (log[0], log2[0], lx, 1.0)}
        right = {"y": (one[1], one[2], cy, 1.0), "ln": (one[3], one[4], ly, 1.0)}
        sst = right["y"][1] - right["y"][0] ** 2 / n if n else 0.0
        spread = z2[0] - z[0] ** 2 / n if n else 0.0
        if n < LEAST_ROWS or spread <= 1e-14 * z2[0] or sst <= 1e-14 * right["y"][1]:
            continue
        all_x, all_y = positive[0] == n, one[5] == n
        for form, a, b, product, able in (("linear", "x", "y", z[1], True), ("log-x", "ln", "y", log[1], all_x), ("log-y", "x", "ln", z[3], all_y), ("log-log", "ln", "ln", log[3], all_x and all_y)):
            if not able:
                continue
            (ta, qa, ca, ua), (tb, qb, cb, ub) = left[a], right[b]
            va, vb, cab = qa - ta * ta / n, qb - tb * tb / n, product - ta * tb / n
            if va <= 0 or vb <= 0:
                continue
            slope, r2 = float(cab / va * ub / ua), float(min(1.0, cab * cab / (va * vb)))
            intercept = float(cb + ub * tb / n - slope * (ca + ua * ta / n))
            fit = Fit(p, form, n, r2, r2, adjusted(r2, n, 1), model_p(r2, n, 1), {"intercept": intercept, p: slope}, float(cab / va * math.sqrt(va / vb)), "positive" if slope >= 0 else "negative", _equation(target, p, form, intercept, slope))
            fits.append(fit)
            if b == "ln":
                fit.caveat = f"fitted on ln({target}); R2 is stated on the scale of {target}"
                back.append((fit, float(sst)))
        moments = {"mx": float(cx), "sx": float(sx), "my": float(cy)}
        sums = {"z1": z[0], "z2": z2[0], "z3": z3[0], "z4": z4[0], "zv": z[1], "z2v": z2[1], "v1": one[1], "vv": one[2]}
        fits += [f for f in [_quadratic(target, p, n, moments, {a: float(b) for a, b in sums.items()})] if f]
    return fits, back


def settle(back: Sequence[tuple[Fit, float]], residuals: Sequence[float]) -> None:
    for (fit, sst), rest in zip(back, residuals, strict=True):
        fit.r2 = float(1 - rest / sst)
        fit.adj_r2 = adjusted(fit.r2, fit.n, 1)


def _equation(target: str, p: str, form: str, a: float, b: float) -> str:
    left = f"ln({target})" if form in ("log-y", "log-log") else target
    right = f"ln({p})" if form in ("log-x", "log-log") else p
    return f"{left} = {a:.4g} {'+' if b >= 0 else '-'} {abs(b):.4g} * {right}"


def _quadratic(target: str, p: str, n: int, s, q: dict) -> Fit | None:
    """y on x and x squared by the two normal equations in standardised x; None where x has too few values."""
    m1, m2, m3, m4 = q["z1"] / n, q["z2"] / n, q["z3"] / n, q["z4"] / n
    a11, a12, a22 = m2 - m1 * m1, m3 - m1 * m2, m4 - m2 * m2
    c1, c2 = (q["zv"] - q["z1"] * q["v1"] / n) / n, (q["z2v"] - q["z2"] * q["v1"] / n) / n
    det, sst = a11 * a22 - a12 * a12, (q["vv"] - q["v1"] ** 2 / n) / n
    if det <= 1e-12 * a11 * max(a22, 1e-300) or sst <= 0:
        return None
    b1, b2 = (c1 * a22 - c2 * a12) / det, (a11 * c2 - a12 * c1) / det
    r2 = max(0.0, min(1.0, (b1 * c1 + b2 * c2) / sst))
    # back from z = (x - m) / d
    m, d = s["mx"], s["sx"]
    two, one = b2 / d**2, b1 / d - 2 * b2 * m / d**2
    zero = s["my"] + q["v1"] / n - b1 * m1 - b2 * m2 - b1 * m / d + b2 * m * m / d**2
    return Fit(p, "quadratic", n, r2, r2, adjusted(r2, n, 2), model_p(r2, n, 2), {"intercept": zero, p: one, f"{p}^2": two}, None, "positive" if b1 >= 0 else "negative", f"{target} = {zero:.4g} + {one:.4g} * {p} + {two:.4g} * {p}^2")


def categorical_fits(df: DataFrame, target: str, predictors: Sequence[str]) -> list[Fit]:
    """Level means as a regression on dummies, the first level in text order the baseline; groups of any size."""
    fits = [categorical_of(target, p, groups) for (_, p), groups in group_moments(df, [target], predictors).items()]
    return sorted((f for f in fits if f), key=lambda f: list(predictors).index(f.predictor))


def categorical_of(target: str, p: str, groups: Sequence[Group]) -> Fit | None:
    """The fit of level means, levels in text order; None under 12 rows, with one level or without spread."""
    if not groups:
        return None
    n, k = sum(g.n for g in groups), len(groups) - 1
    grand = sum(g.n * g.mean for g in groups) / n
    between, within = sum(g.n * (g.mean - grand) ** 2 for g in groups), sum(g.m2 for g in groups)
    if n < LEAST_ROWS or k < 1 or between + within <= 0:
        return None
    r2 = between / (between + within)
    coefficients = {"intercept": groups[0].mean} | {f"{p}_{g.level}": g.mean - groups[0].mean for g in groups[1:]}
    return Fit(p, "categorical", n, r2, r2, adjusted(r2, n, k), model_p(r2, n, k), coefficients, None, "", f"{target} = mean of {p}")


def best_fits(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str]) -> list[Fit]:
    """Each predictor's form with the best finite adjusted R2, best first; the earlier form and predictor of equals."""
    return best_of(ladder(df, target, [c for c in numeric if c != target]) + categorical_fits(df, target, [c for c in categorical if c != target]))


def best_of(fits: Sequence[Fit]) -> list[Fit]:
    best: dict[str, Fit] = {}
    for f in fits:
        if math.isfinite(f.adj_r2) and (f.predictor not in best or f.adj_r2 > best[f.predictor].adj_r2):
            best[f.predictor] = f
    return sorted(best.values(), key=lambda f: -f.adj_r2)


FITS_SCHEMA = "predictor string, form string, n long, native_r2 double, r2 double, adj_r2 double, p_value double, intercept double, slope double, std_coefficient double, direction string"


def fits_frame(spark, fits: Sequence[Fit]) -> DataFrame:
    return spark.createDataFrame([(f.predictor, f.form, f.n, f.native_r2, f.r2, f.adj_r2, f.p_value, f.coefficients["intercept"], f.coefficients.get(f.predictor), f.std_coefficient, f.direction) for f in fits], FITS_SCHEMA)
