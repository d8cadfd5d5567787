"""Association tests between all pairs of columns, from counts and moments that Spark aggregates over all rows."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.tails import chi2_tail, f_tail, t_two_sided
from loomwork.operators.moments import pairwise
from loomwork.operators.nodes import quoted
from loomwork.operators.ranks import cumulated, smallest_after
from loomwork.scratch import materialize, scratch

LEAST_PAIRS, LEAST_GROUP = 8, 3


@dataclass
class PairTest:
    """One test; ``effect`` is 0 to 1 whatever the test, so that different tests rank together."""

    a: str
    b: str
    kind: str  # num-num, num-cat, cat-cat
    test: str
    statistic: float
    p_value: float
    effect: float
    effect_name: str
    n: int
    direction: str = ""
    detail: dict = field(default_factory=dict)


def number(name: str) -> Column:
    """A column as a double; NaN and booleans as mining takes them."""
    c = quoted(name).cast("double")
    return F.when(~F.isnan(c), c)


def rank_columns(held: DataFrame, keys: Sequence[tuple[str, str | None]]) -> DataFrame:
    """row, r0, r1, ...: for key (a, b) the average rank of ``a`` among the rows of ``held`` (row, columns) where b is there too; null elsewhere.

    All keys are ranked together: values by key are counted, range-partitioned
    and summed by ranges; ranks meet the rows by plain joins, which adaptive
    execution splits where one value is most rows.
    """
    each = F.array(*[F.struct(F.lit(k).alias("key"), (F.col(a) if b is None else F.when(F.col(b).isNotNull(), F.col(a))).alias("x")) for k, (a, b) in enumerate(keys)])
    melted = held.select("row", F.explode(each).alias("e")).select("row", "e.*").filter("x is not null")
    ranks = cumulated(melted, F.col("x"), [F.col("key")]).select(F.col("k0").alias("key"), F.col("value").alias("x"), (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    met = melted.join(ranks, ["key", "x"])
    return met.groupBy("row").agg(*[F.max(F.when(F.col("key") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(keys))])


def pearson_tests(df: DataFrame, columns: Sequence[str], rank: bool = True) -> list[PairTest]:
    """Pearson's r of every pair over the rows where both are there, with n >= 8 and spread in both; two-sided p; ``detail`` has r_squared and, with ``rank``, Spearman's rho.

    The columns are written once, with a number for each row, and read for the
    cross-products and the ranks. A rank is among the rows of its pair; pairs
    whose missing values leave a column the same rows share its ranks.
    """
    if len(columns) < 2:
        return []
    names = [f"x{k}" for k in range(len(columns))]
    with scratch(df.sparkSession):
        held = materialize(df.select(F.monotonically_increasing_id().alias("row"), *[number(c).alias(x) for x, c in zip(names, columns, strict=True)]), "pair-columns")
        sums = pairwise(held, names)
        found = [(a, b, n, r) for a, b in combinations(range(len(columns)), 2) for n, r in [sums.correlation(a, b)] if n >= LEAST_PAIRS and r is not None]
        rho = spearman_of(held, names, sums.n, [(a, b) for a, b, _, _ in found]) if rank and found else {}
    return pearson_of(columns, found, rho)


def pearson_of(columns: Sequence[str], found: Sequence[tuple[int, int, int, float]], rho: dict[tuple[int, int], float | None]) -> list[PairTest]:
    """Tests of (a, b, n, r), places in ``columns``."""
    out = []
    for a, b, n, r in found:
        t = math.inf if abs(r) == 1 else r * math.sqrt((n - 2) / (1 - r * r))
        detail = {"r_squared": r * r} | ({"rho": rho[a, b]} if (a, b) in rho else {})
        out.append(PairTest(columns[a], columns[b], "num-num", "pearson", r, t_two_sided(t, n - 2), abs(r), "|r|", n, "positive" if r >= 0 else "negative", detail))
    return out


def spearman_of(held: DataFrame, names: Sequence[str], n: np.ndarray, wanted: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float | None]:
    """rho of the wanted pairs of ``held`` (row, names): Pearson's r of their ranks; ``n`` counts the rows of each pair."""
    # Columns with the same rows missing stand for one another where they only say which rows count.
    like = [next(c for c in range(len(names)) if n[b, b] == n[c, c] == n[b, c]) for b in range(len(names))]
    key = lambda a, b: (names[a], None if n[a, b] == n[a, a] else names[like[b]])
    keys = sorted({k for a, b in wanted for k in (key(a, b), key(b, a))}, key=lambda k: (names.index(k[0]), k[1] or ""))
    rows = [n[names.index(a), names.index(a) if b is None else names.index(b)] for a, b in keys]
    sums = pairwise(rank_columns(held, keys), [f"r{k}" for k in range(len(keys))], [(m + 1) / 2 for m in rows])
    return {(a, b): sums.correlation(keys.index(key(a, b)), keys.index(key(b, a)))[1] for a, b in wanted}


def average_ranks(df: DataFrame, name: str) -> DataFrame:
    """value, rank of each distinct value of a column, ties at their mean rank; sorted and summed by ranges, not in one task."""
    return cumulated(df, number(name)).select("value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and rho of two columns over the rows where both are there: Pearson's r of average ranks."""
    both = df.select(number(a).alias("x"), number(b).alias("y")).dropna()
    rx, ry = average_ranks(both, "x"), average_ranks(both, "y")
    cells = both.groupBy("x", "y").agg(F.count("*").alias("w"))
    ranked = cells.join(rx.select(F.col("value").alias("x"), F.col("rank").alias("rx")), "x").join(ry.select(F.col("value").alias("y"), F.col("rank").alias("ry")), "y")
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    mean = (F.col("n") + 1) / 2
    sums = ranked.crossJoin(F.broadcast(both.agg(F.count("*").alias("n")))).agg(F.max("n").alias("n"), F.sum(w * (x - mean) * (y - mean)).alias("xy"), F.sum(w * (x - mean) ** 2).alias("xx"), F.sum(w * (y - mean) ** 2).alias("yy"))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


@dataclass
class Group:
    level: str
    n: int
    mean: float
    m2: float  # sum of squared deviations from the group's mean


def group_moments(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[tuple[str, str], list[Group]]:
    """(value, group) to moments by level, for all pairs: one pass, aggregated by (column, level)."""
    if not numeric or not categorical:
        return {}
    levels = F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("string").alias("level")) for c in categorical])
    values = df.select(*[number(x).alias(f"x{k}") for k, x in enumerate(numeric)], F.explode(levels).alias("g")).filter("g.level is not null")
    rows = values.groupBy("g.c", "g.level").agg(*[F.struct(F.count(f"x{k}").alias("n"), F.avg(f"x{k}").alias("m"), F.var_pop(f"x{k}").alias("v")).alias(f"s{k}") for k in range(len(numeric))]).collect()
    found: dict[tuple[str, str], list[Group]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["c"], r["level"])):
        for k, x in enumerate(numeric):
            s = r[f"s{k}"]
            if s["n"]:
                found[x, r["c"]].append(Group(r["level"], s["n"], s["m"], s["v"] * s["n"]))
    return found


def level_cells(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], center: Sequence[float]) -> DataFrame:
    """x, c (places in ``numeric`` and ``categorical``), level, n, mean, m2 of every group: one pass, aggregated by (column, level); means less ``center``."""
    levels = F.array(*[F.struct(F.lit(k).alias("c"), quoted(c).cast("string").alias("level")) for k, c in enumerate(categorical)])
    values = df.select(*[(number(x) - float(m)).alias(f"x{k}") for k, (x, m) in enumerate(zip(numeric, center, strict=True))], F.explode(levels).alias("g")).filter("g.level is not null")
    cells = values.groupBy("g.c", "g.level").agg(*[F.struct(F.lit(k).alias("x"), F.count(f"x{k}").alias("n"), F.avg(f"x{k}").alias("mean"), F.var_pop(f"x{k}").alias("v")).alias(f"s{k}") for k in range(len(numeric))])
    return cells.select("c", "level", F.explode(F.array(*[f"s{k}" for k in range(len(numeric))])).alias("s")).select("s.x", "c", "level", "s.n", "s.mean", (F.col("s.v") * F.col("s.n")).alias("m2")).filter("n > 0")


#: Groups are told in a test's detail where there are so many or fewer.
DETAIL_LEVELS = 50


def anova_tests(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[PairTest]:
    """One-way analyses of variance of all (number, category) pairs over groups of three rows or more, at least two of them, with some spread.

    Groups stay on the executors, however many levels a column has; one row a
    pair reaches the driver, and the groups of those with ``DETAIL_LEVELS`` or fewer.
    """
    if not numeric or not categorical:
        return []
    center = [m or 0.0 for m in df.agg(*[F.avg(number(x)) for x in numeric]).first()]
    with scratch(df.sparkSession):
        cells = materialize(level_cells(df, numeric, categorical, center).filter(F.col("n") >= LEAST_GROUP), "anova-groups")
        n, m = F.col("n"), F.col("mean")
        sums = {(r["x"], r["c"]): r for r in cells.groupBy("x", "c").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * m).alias("s"), F.sum(n * m * m).alias("ss"), F.sum("m2").alias("within")).collect()}
        few = [F.struct(F.lit(x).alias("x"), F.lit(c).alias("c")) for (x, c), r in sums.items() if r["k"] <= DETAIL_LEVELS]
        told = cells.filter(F.struct("x", "c").isin(few)).orderBy("x", "c", "level").collect() if few else []
    groups: dict[tuple[int, int], dict[str, dict]] = defaultdict(dict)
    for r in told:
        groups[r["x"], r["c"]][r["level"]] = {"n": r["n"], "mean": r["mean"] + center[r["x"]]}
    out = []
    for (x, c), r in sorted(sums.items()):
        between = max(r["ss"] - r["s"] ** 2 / r["n"], 0.0)
        # What rounding leaves of groups with equal means is no spread.
        out.append(anova_of(numeric[x], categorical[c], r["k"], r["n"], between if between > 1e-14 * r["ss"] else 0.0, r["within"], groups[x, c]))
    return [t for t in out if t]


def anova_of(value: str, group: str, k: int, n: int, between: float, within: float, groups: dict[str, dict]) -> PairTest | None:
    """The test of k groups with n rows in all, from the squares between and within them; None without two groups or spread."""
    if k < 2 or between + within <= 0:
        return None
    f = math.inf if within <= 0 else (between / (k - 1)) / (within / (n - k))
    eta = max(0.0, min(1.0, between / (between + within)))
    detail = {"levels": k} | ({"groups": groups} if k <= DETAIL_LEVELS else {})
    return PairTest(value, group, "num-cat", "anova", f, f_tail(f, k - 1, n - k), eta, "eta squared", n, "", detail)


def chi_square_tests(df: DataFrame, categorical: Sequence[str]) -> list[PairTest]:
    """Independence of every pair of columns over the rows where both are there; with one degree of freedom Yates's correction applies.

    Only cells that are there are counted; a missing cell adds its expected
    count, and these sum to n less the expected counts of the others, which are
    added up exactly. Margins are aggregates of the cells. One row a pair
    reaches the driver, however many levels there are.
    """
    pairs = list(combinations(categorical, 2))
    if not pairs:
        return []
    each = F.array(*[F.struct(F.lit(k).alias("k"), quoted(a).cast("string").alias("a"), quoted(b).cast("string").alias("b")) for k, (a, b) in enumerate(pairs)])
    with scratch(df.sparkSession):
        cells = materialize(df.select(F.explode(each).alias("x")).select("x.*").dropna().groupBy("k", "a", "b").agg(F.count("*").alias("n")), "chi-cells")
        rows, columns = (cells.groupBy("k", side).agg(F.sum("n").alias(f"n{side}")) for side in "ab")
        margins = [m.groupBy("k").agg(F.count("*").alias(f"levels_{side}"), F.sum(1 / F.col(f"n{side}")).alias(f"inverse_{side}"), F.sum(f"n{side}").alias(f"total_{side}")) for side, m in (("a", rows), ("b", columns))]
        whole = margins[0].join(margins[1], "k")  # one row a pair
        met = cells.join(rows, ["k", "a"]).join(columns, ["k", "b"]).join(F.broadcast(margins[0].select("k", F.col("total_a").alias("total"))), "k")
        expected, product = F.col("na") * F.col("nb") / F.col("total"), F.col("na").cast("decimal(18,0)") * F.col("nb").cast("decimal(18,0)")
        sums = met.groupBy("k").agg(F.sum((F.col("n") - expected) ** 2 / expected).alias("chi2"), F.sum(product).alias("there"), F.max(F.abs(F.col("n") - expected)).alias("off"))
        found = {r["k"]: r for r in sums.join(whole, "k").collect()}
    out = []
    for k, (a, b) in enumerate(pairs):
        if (r := found.get(k)) is None or min(r["levels_a"], r["levels_b"]) < 2:
            continue
        n = r["total_a"]
        chi2 = r["chi2"] + float(n * n - int(r["there"])) / n
        out.append(chi_square_of(a, b, r["levels_a"], r["levels_b"], n, chi2, r["off"], n * r["inverse_a"] * r["inverse_b"]))
    return out


def chi_square_of(a: str, b: str, levels_a: int, levels_b: int, n: int, chi2: float, off: float, inverse: float) -> PairTest:
    """``off``: by how much a cell differs from what is expected, at most; ``inverse``: the sum of 1 / expected. Both matter with one degree of freedom only."""
    dof = (levels_a - 1) * (levels_b - 1)
    if dof == 1:  # all four cells are off by as much
        chi2 = (off - min(0.5, off)) ** 2 * inverse
    v = min(1.0, math.sqrt(chi2 / (n * (min(levels_a, levels_b) - 1))))
    return PairTest(a, b, "cat-cat", "chi-square", chi2, chi2_tail(chi2, dof), v, "Cramer's V", n, "", {"dof": dof})


def all_pairs(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[PairTest]:
    """Every pair's test in column order, numeric columns first; one row a pair reaches the driver, whatever the number of rows and levels."""
    tests = pearson_tests(df, numeric) + anova_tests(df, numeric, categorical) + chi_square_tests(df, categorical)
    at = {c: k for k, c in enumerate([*numeric, *categorical])}
    return sorted(tests, key=lambda t: (at[t.a], at[t.b]))


def benjamini_hochberg(p_values: Sequence[float], alpha: float = 0.05) -> tuple[list[float], list[bool]]:
    """q-values and rejections: the running minimum, from the largest p down, of p * n / rank."""
    n = len(p_values)
    q, least = [0.0] * n, 1.0
    for rank, k in reversed(list(enumerate(sorted(range(n), key=lambda k: p_values[k]), 1))):
        least = min(least, p_values[k] * n / rank)
        q[k] = least
    return q, [x <= alpha for x in q]


def with_q_values(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """A tests frame with ``q_value`` and ``significant``: the same correction as columns, for frames of any length.

    Equal p-values share their q-value, so it is found for each distinct one,
    by ranges. Rows without a p-value have neither and count for nothing.
    """
    c = quoted(p)
    rate = F.col("value") * F.col("total") / (F.col("before") + F.col("n"))
    found = smallest_after(tests, c, rate).select(F.col("value").alias("__p"), F.least(F.lit(1.0), F.col("least")).alias("q_value"))
    return tests.join(found, c == F.col("__p"), "left").drop("__p").withColumn("significant", F.col("q_value") <= alpha)


TESTS_SCHEMA = "a string, b string, kind string, test string, statistic double, p_value double, effect double, effect_name string, n long, direction string, rho double"


def tests_frame(spark, tests: Sequence[PairTest]) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in TESTS_SCHEMA.split(",")]
    return spark.createDataFrame([tuple({**asdict(t), "rho": t.detail.get("rho")}[n] for n in names) for t in tests], TESTS_SCHEMA)
