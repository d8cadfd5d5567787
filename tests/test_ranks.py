"""Ranks, quantiles and false discovery rates by ranges against numpy and the plain list."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.operators import charts, nodes, pairs, profile, ranks


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 1.0, 2.5, float(rng.randint(-50, 50))])) for _ in range(n)] + [("only", 7.0), ("none", None)]


def test_quantiles_by_key_and_over_all(spark):
    data = rows(1, 500)
    df = spark.createDataFrame(data, "g string, v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = {r["k0"]: r for r in ranks.quantiles(df, F.col("v"), shares, [F.col("g")]).collect()}
    assert set(got) == {"a", "b", None, "only"}
    for g, r in got.items():
        held = [v for k, v in data if k == g and v is not None]
        assert np.allclose([r[f"q{i}"] for i in range(6)], np.quantile(held, shares)) and (r["n"], r["levels"]) == (len(held), len(set(held)))
    whole = ranks.quantiles(df, F.col("v"), (0.3,)).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["q0"], np.quantile([v for _, v in data if v is not None], 0.3))
    empty = ranks.quantiles(df.limit(0), F.col("v"), (0.5,)).collect()
    assert [tuple(r) for r in empty] == [(None, 0, 0)]
    assert nodes.outliers(df.withColumn("v", F.lit(None).cast("double")), "v").filter("is_outlier").count() == 0
    assert nodes.outliers(df.withColumn("v", F.lit(None).cast("double")), "v").count() == len(data)


def test_one_value_may_be_most_rows(spark):
    df = spark.createDataFrame([(k, 5.0 if k % 3 else float(k)) for k in range(900)], "k long, v double")
    held = sorted(5.0 if k % 3 else float(k) for k in range(900))
    found = {r["value"]: (r["before"], r["n"], r["total"]) for r in ranks.cumulated(df, F.col("v")).collect()}
    assert all(found[v] == (held.index(v), held.count(v), 900) for v in set(held))


def test_q_values_of_frames_are_those_of_lists(spark):
    rng = random.Random(4)
    p = [rng.choice([0.01, 0.04, 0.5, 1.0, rng.random()]) for _ in range(200)]
    df = spark.createDataFrame([(k, x, "q") for k, x in enumerate(p)] + [(999, None, "q")], "k long, p_value double, value string")
    got = {r["k"]: (r["q_value"], r["significant"]) for r in pairs.with_q_values(df).collect()}
    q, significant = pairs.benjamini_hochberg(p)
    assert len(got) == 201 and got[999] == (None, None)
    assert all(np.isclose(got[k][0], q[k]) and got[k][1] == significant[k] for k in range(200))
    assert pairs.with_q_values(df.limit(0)).count() == 0


def test_large_samples_are_those_of_the_least_hashes(spark, monkeypatch):
    df = spark.range(60_000).select((F.col("id") % 50_000).alias("k"), (F.col("id") % 50_000 * 2).alias("v"))  # 10,000 rows twice
    keys = sorted(r[0] for r in df.select(F.xxhash64(F.lit(3), "k", "v")).collect())
    for parts, rows in ((1, 25_000), (7, 25_000), (3, 40_001)):
        for small in (100_000, 3):
            monkeypatch.setattr(nodes, "SAMPLE_BIN", small)
            got = nodes.sample(df.repartition(parts), rows, 3)
            assert sorted(r[0] for r in got.select(F.xxhash64(F.lit(3), "k", "v")).collect()) == keys[:rows]
    assert nodes.sample(df, 60_000, 3).count() == 60_000 and nodes.sample(df, 100_000, 3).count() == 60_000
    same = spark.range(30_000).select(F.lit(1).alias("k"))
    assert nodes.sample(same, 20_000).count() == 20_000
    import hashlib

    want = sorted(range(60_000), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest()[:15])[:15_000]
    assert {r[0] for r in nodes.sample(spark.range(60_000), 15_000, 9, ["id"]).collect()} == set(want)
    plan = nodes.sample(df, 25_000, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_medians_and_distinct_counts_by_ranges(spark):
    data = rows(5, 700)
    df = spark.createDataFrame(data, "g string, v double").withColumn("w", F.col("v") * 2)
    got = profile.governed_aggregate(df, [("median", "v"), ("count", "*"), ("median", "w"), ("max", "v")], ["g"], min_group_size=2)
    assert got.columns == ["g", "median_v", "count_rows", "median_w", "max_v"]
    for r in got.collect():
        held = [v for g, v in data if g == r["g"] and v is not None]
        assert np.isclose(r["median_v"], np.median(held)) and np.isclose(r["median_w"], 2 * np.median(held)) and r["max_v"] == max(held)
    assert [r["g"] for r in got.collect()] == ["a", "b", None]
    assert np.isclose(profile.governed_aggregate(df, [("median", "v")]).first()[0], np.median([v for _, v in data if v is not None]))
    stats = profile.column_stats(df, "g").first()
    assert (stats["rows"], stats["distinct"]) == (len(data), 4)
    bar = charts.chart(df, charts.ChartSpec("bar", "g", "v", agg="median")).df.collect()
    assert [(r["x"], r["y"]) for r in bar] == sorted(((g, float(np.median(h)) if (h := [v for k, v in data if k == g and v is not None]) else None) for g in ("a", "b", "only", "none")), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))


def test_any_number_of_series_is_folded(spark):
    df = spark.range(20_000).select(F.lit(1).alias("x"), F.format_string("s%05d", "id").alias("series"), (F.col("id") % 5_000).cast("double").alias("y"))
    folded = charts.fold_series(df)
    kept = {r[0] for r in folded.filter("series != 'Other'").select("series").distinct().collect()}
    assert kept == {f"s{k:05d}" for k in (4999, 9999, 14999, 19999, 4998, 9998, 14998, 19998)} and folded.count() == 20_000
    assert {r[0] for r in charts.fold_series(df.withColumn("x", -F.col("y")), by="x").filter("series != 'Other'").select("series").distinct().collect()} == kept
