"""Cumulated counts of values by ranges: ranks, exact quantiles and false discovery rates without one task for all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.scratch import materialize


def cumulated(df: DataFrame, value: Column, by: Sequence[Column] = ()) -> DataFrame:
    """k0, k1, ... (the keys ``by``), value, n, before, total of each distinct value that is there.

    ``n`` rows have the value, ``before`` of its keys' ``total`` rows a smaller
    one. Counts are range-partitioned and summed within ranges; what is summed
    over ranges is one row for each range of a key. Equal values are one row,
    so no value's frequency makes a large task.
    """
    keys = [f"k{i}" for i in range(len(by))]
    counts = df.select(*[c.alias(k) for c, k in zip(by, keys, strict=True)], value.alias("value")).filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    ranged = materialize(counts.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("held"))
    starts = held.select(*[F.col(k).alias(f"s{k}") for k in keys], F.col("part").alias("spart"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"), F.sum("held").over(whole).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("value")) - F.col("n")
    same = F.col("part") == F.col("spart")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s{k}"))
    return ranged.withColumn("within", within).join(starts, same).select(*keys, "value", "n", (F.col("start") + F.col("within")).alias("before"), "total")


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], by: Sequence[Column] = ()) -> DataFrame:
    """k0, ..., q0, q1, ..., n, levels: exact interpolated quantiles, rows and distinct values by key; without keys always one row."""
    held = cumulated(df, value.cast("double"), by)
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))
    made = []
    for i, p in enumerate(shares):
        place = F.lit(float(p)) * (F.col("total") - 1)
        made += [at(F.floor(place)).alias(f"lo{i}"), at(F.ceil(place)).alias(f"hi{i}"), F.max(place - F.floor(place)).alias(f"f{i}")]
    keys = [f"k{i}" for i in range(len(by))]
    found = held.groupBy(*keys).agg(*made, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("levels"))
    return found.select(*keys, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")).alias(f"q{i}") for i in range(len(shares))], "n", "levels")


def with_medians(groups: DataFrame, df: DataFrame, keys: dict[str, Column], medians: dict[str, Column]) -> DataFrame:
    """``groups`` with exact medians of ``df`` by name, a null key a key as any; ``keys``: columns of ``groups`` and what they are of ``df``.

    Each median comes from cumulated counts of its values, so a group may hold
    any number of them.
    """
    for name, value in medians.items():
        found = quantiles(df, value, (0.5,), list(keys.values())).select(*[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(keys))], F.col("q0").alias(name))
        if not keys:
            groups = groups.crossJoin(F.broadcast(found))  # one row
            continue
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
        groups = groups.join(found, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    return groups


def distinct_values(df: DataFrame, value: Column) -> DataFrame:
    """One row, distinct: how many values there are, null left out; values are grouped and counted, none held in a set."""
    return df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.lit(1)).agg(F.count("*").alias("distinct"))


def smallest_after(df: DataFrame, value: Column, measure: Column) -> DataFrame:
    """value, least: of each distinct value the least ``measure`` of it and of all larger values; ``measure`` may use before, n, total, value."""
    held = materialize(cumulated(df, value).withColumn("m", measure).repartitionByRange("value").withColumn("part", F.spark_partition_id()), "least")
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    ends = held.groupBy("part").agg(F.min("m").alias("end")).select(F.col("part").alias("epart"), F.min("end").over(later).alias("later"))
    down = Window.partitionBy("part").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("own", F.min("m").over(down)).join(F.broadcast(ends), F.col("part") == F.col("epart")).select("value", F.least("own", "later").alias("least"))
