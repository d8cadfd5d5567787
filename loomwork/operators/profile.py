"""Column profiles and governed aggregates: few wide aggregates over all rows, not a query for each column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.nodes import column, quoted, sample
from loomwork.operators.ranks import distinct_values, quantiles, with_medians

BINS = 10
TOP = 8
ROWS = 200
METRICS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp}
#: Metrics that are no aggregate expression.
MEDIAN = "median"


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def column_counts(df: DataFrame, exact: bool = False) -> DataFrame:
    """column, type, rows, nulls, distinct of every column, by one aggregate; distinct is approximate unless ``exact``."""
    count = F.countDistinct if exact else F.approx_count_distinct
    whole = lambda f: F.to_json(F.struct(quoted(f.name))) if is_nested(f.dataType) else quoted(f.name)
    found = df.agg(
        F.count("*").alias("rows"),
        *[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(quoted(f.name).isNull()).alias("nulls"), count(whole(f)).alias("distinct")).alias(f"c{k}") for k, f in enumerate(df.schema.fields)],
    )
    return found.select("rows", F.explode(F.array(*[F.col(f"c{k}") for k in range(len(df.columns))])).alias("x")).select("x.column", "x.type", "rows", "x.nulls", "x.distinct")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, min, max, mean, stddev (sample) of numeric columns, by one aggregate."""
    names = [column(df, c) for c in columns] if columns else numeric_columns(df)
    parts = [F.struct(F.lit(c).alias("column"), F.min(quoted(c)).cast("double").alias("min"), F.max(quoted(c)).cast("double").alias("max"), F.avg(quoted(c)).cast("double").alias("mean"), F.stddev_samp(quoted(c).cast("double")).alias("stddev")).alias(f"c{k}") for k, c in enumerate(names)]
    return df.agg(*parts).select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(names))])).alias("x")).select("x.*")


def histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """column, bin, lo, hi, n: equal-width bins of all numeric columns at once, empty bins included.

    A value is in bin ``least(floor((v - min) / width), bins - 1)``; a constant
    column has one bin; a column of nulls has none. The bounds, one row for
    each column, are broadcast.
    """
    names = [column(df, c) for c in columns] if columns else numeric_columns(df)
    bounds = numeric_summary(df, names).filter("min is not null").select("column", F.col("min").alias("a"), F.col("max").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("v")) for c in names])).alias("x")).select("x.*").filter("v is not null")
    placed = melted.join(F.broadcast(bounds), "column").withColumn("bin", F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).cast("int"))
    counts = placed.groupBy("column", "bin").agg(F.count("*").alias("n"))
    every = bounds.select("column", "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    lo = F.col("a") + F.col("bin") * width
    return every.join(counts, ["column", "bin"], "left").select("column", "bin", lo.alias("lo"), F.when(F.col("bin") == bins - 1, F.col("b")).otherwise(lo + width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, top: int = TOP) -> DataFrame:
    """column, value, n: the most frequent values as text of each non-numeric column, ties by value; nulls left out."""
    names = [column(df, c) for c in columns] if columns else [f.name for f in df.schema.fields if not is_number(f.dataType) and not is_nested(f.dataType)]
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*").filter("value is not null")
    counts = melted.groupBy("column", "value").agg(F.count("*").alias("n"))
    # A rank within each of some shards first: no task sorts all values of a column with very many of them.
    shard = counts.withColumn("s", F.abs(F.hash("value")) % 64)
    order = [F.desc("n"), F.col("value")]
    some = shard.withColumn("k", F.row_number().over(Window.partitionBy("column", "s").orderBy(*order))).filter(F.col("k") <= top)
    return some.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(*order))).filter(F.col("k") <= top).select("column", "value", "n")


def profile(df: DataFrame, max_rows: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """counts, numeric, histograms and top values of a table; of all rows, or of a seeded sample of ``max_rows``."""
    held = sample(df, max_rows, seed) if max_rows else df
    out = {"counts": column_counts(held)}
    if numeric_columns(held):
        out |= {"numeric": numeric_summary(held), "histograms": histograms(held)}
    if any(not is_number(f.dataType) and not is_nested(f.dataType) for f in held.schema.fields):
        out["top"] = top_values(held)
    return out


def column_stats(df: DataFrame, name: str, accuracy: int | None = None) -> DataFrame:
    """rows, nulls, distinct and, of a numeric column, min, max, mean, stddev, median: one row.

    Both are exact, the median by ranges of values; ``accuracy`` takes approximate ones.
    """
    c, numeric = quoted(column(df, name)), is_number(df.schema[column(df, name)].dataType)
    parts = [F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls")] + ([rough_distinct(c).alias("distinct")] if accuracy else [])
    if numeric:
        parts += [F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("stddev")]
    if numeric and accuracy:
        parts.append(F.percentile_approx(c, 0.5, accuracy).cast("double").alias("median"))
    found = df.agg(*parts)
    if accuracy:
        return found
    # One row each.
    more = quantiles(df, c, (0.5,)).select(F.col("levels").alias("distinct"), F.col("q0").alias("median")) if numeric else distinct_values(df, c)
    whole = found.crossJoin(F.broadcast(more))
    return whole.select("rows", "nulls", "distinct", *[x for x in whole.columns if x not in ("rows", "nulls", "distinct")])


def governed_aggregate(df: DataFrame, metrics: Sequence[tuple[str, str]], group_by: Sequence[str] = (), limit: int = ROWS, min_group_size: int = 1) -> DataFrame:
    """Aggregates only, never a row: (metric, column) pairs of a closed list, named ``metric_column``, ordered by the keys.

    Medians are exact, by ranges of the values of the groups that are shown.
    ``count`` of ``*`` counts rows. Groups under ``min_group_size`` rows are left out. At most ``limit`` and 200 rows.
    """
    if not metrics:
        raise ValueError("an aggregate needs a metric")

    def one(metric: str, name: str) -> Column:
        if name == "*":
            if metric != "count":
                raise ValueError(f"{metric} needs a column")
            return F.count("*").alias("count_rows")
        return METRICS[metric](quoted(column(df, name))).alias(f"{metric}_{column(df, name)}")

    if unknown := [m for m, _ in metrics if m not in METRICS and m != MEDIAN]:
        raise ValueError(f"unknown metric {unknown[0]!r}: {', '.join([*METRICS, MEDIAN])}")
    if (MEDIAN, "*") in metrics:
        raise ValueError("median needs a column")
    keys, medians = [column(df, g) for g in group_by], {f"median_{column(df, c)}": quoted(column(df, c)) for m, c in metrics if m == MEDIAN}
    order = [quoted(k).asc_nulls_last() for k in keys]
    found = df.groupBy(*map(quoted, keys)).agg(*[one(m, c) for m, c in metrics if m != MEDIAN], F.count("*").alias("__n"))
    sort = lambda x: x.orderBy(*order) if order else x
    found = sort(found.filter(F.col("__n") >= min_group_size).drop("__n")).limit(max(1, min(limit, ROWS)))
    if not medians:
        return found
    # Medians of the groups that are shown, which are few.
    shown = df
    if keys:
        few = F.broadcast(found.select(*[quoted(k).alias(f"__s{i}") for i, k in enumerate(keys)]))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & quoted(k).eqNullSafe(F.col(f"__s{i}"))
        shown = df.join(few, same, "left_semi")
    out = with_medians(found, shown, {k: quoted(k) for k in keys}, medians)
    named = [f"{m}_{column(df, c)}" if c != "*" else "count_rows" for m, c in metrics]
    return sort(out.select(*map(quoted, [*keys, *named])))


def capped(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """At most ``rows`` rows, any."""
    return df.limit(rows)


#: Levels of a categorical column at most, and the share of distinct values from which it is an identifier (fixed values).
MAX_LEVELS, IDENTIFIER_SHARE = 30, 0.9


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null, as mining takes it."""
    return df.withColumns({f.name: F.when(~F.isnan(quoted(f.name)), quoted(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))})


#: Relative deviation of rough_distinct().
ROUGH = 0.01


def rough_distinct(c: Column) -> Column:
    """Distinct values by a sketch of 16 KB."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c.cast("string"), F.lit(14))), F.lit(0).cast("long"))


@dataclass
class Summary:
    """Of one column: rows, missing values, distinct values, mean and deviation of numbers, all values as text where there are few."""

    rows: int
    nulls: int
    distinct: int
    mean: float | None
    deviation: float | None
    values: list[str] | None


def summaries(df: DataFrame) -> list[Summary]:
    """Each column's summary, distinct values by a sketch in one pass; another pass has them exactly only where a rule could turn on the difference."""
    plain = [f for f in df.schema.fields if not is_nested(f.dataType)]
    rough = {r["column"]: r for r in _rough_counts(df).collect()}
    few = [f.name for f in plain if rough[f.name]["distinct"] <= 4 * MAX_LEVELS]
    share = lambda r: r["distinct"] / max(r["rows"] - r["nulls"], 1)
    unsure = few + [f.name for f in plain if f.name not in few and abs(share(rough[f.name]) - IDENTIFIER_SHARE) < 5 * ROUGH]
    # the sets of columns with few values stay small
    exact = df.agg(*[(F.collect_set(quoted(c).cast("string")) if c in few else F.countDistinct(quoted(c))).alias(f"c{k}") for k, c in enumerate(unsure)]).first() if unsure else ()
    known = dict(zip(unsure, exact, strict=True))
    out = []
    for c in df.columns:
        r, found = rough[c], known.get(c, rough[c]["distinct"])
        values = sorted(found) if isinstance(found, list) else None
        out.append(Summary(r["rows"], r["nulls"], found if values is None else len(values), r["mean"], r["deviation"], values))
    return out


def _rough_counts(df: DataFrame) -> DataFrame:
    def part(f: T.StructField) -> Column:
        c = quoted(f.name)
        value = c.cast("double") if is_number(f.dataType) or isinstance(f.dataType, T.BooleanType) else F.lit(None).cast("double")
        value = F.when(~F.isnan(value), value)
        distinct = F.lit(0).cast("long") if is_nested(f.dataType) else rough_distinct(c)
        return F.struct(F.lit(f.name).alias("column"), F.count_if(c.isNull()).alias("nulls"), distinct.alias("distinct"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))

    found = df.agg(F.count("*").alias("rows"), *[part(f).alias(f"c{k}") for k, f in enumerate(df.schema.fields)])
    return found.select("rows", F.explode(F.array(*[F.col(f"c{k}") for k in range(len(df.columns))])).alias("x")).select("x.column", "rows", "x.nulls", "x.distinct", "x.mean", "x.deviation")


def roles_of(df: DataFrame, found: Sequence[Summary]) -> list[tuple[int, str, str, str | None]]:
    """(position, column, role, reason) of every column."""
    rows = []
    for k, (f, s) in enumerate(zip(df.schema.fields, found, strict=True)):
        filled, distinct, kind = s.rows - s.nulls, s.distinct, f.dataType
        if filled == 0:
            role, why = "excluded", "all values are missing"
        elif is_nested(kind) or isinstance(kind, T.BinaryType):
            role, why = "excluded", f"nested or binary type {kind.simpleString()}"
        elif distinct <= 1:
            role, why = "excluded", "constant"
        elif isinstance(kind, T.BooleanType) or is_number(kind):
            role, why = "numeric", None
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role, why = "excluded", "date or time"
        elif distinct / filled >= IDENTIFIER_SHARE:
            role, why = "excluded", "looks like an identifier: nearly every value is different"
        elif distinct > MAX_LEVELS:
            role, why = "excluded", f"about {distinct} levels, more than {MAX_LEVELS}"
        else:
            role, why = "categorical", None
        rows.append((k, f.name, role, why))
    return rows


def classify(df: DataFrame) -> DataFrame:
    """column, role (numeric, categorical or excluded), reason for every column; booleans are numbers, NaN is missing."""
    held = without_nan(df)
    return df.sparkSession.createDataFrame(roles_of(df, summaries(held)), "position int, column string, role string, reason string")
