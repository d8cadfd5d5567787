"""Profiles, tests and models against numpy formulas, closed forms and planted truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import tails
from loomwork.operators import model, pairs, profile, regression
from loomwork.plans import scan


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in zip(*columns.values(), strict=True)], names)


def test_tails_against_closed_forms():
    for f, d in ((0.5, 3), (4.0, 10), (30.0, 7)):
        assert math.isclose(tails.f_tail(f, 2, d), (1 + 2 * f / d) ** (-d / 2), rel_tol=1e-12)
    for x in (0.1, 2.0, 50.0):
        assert math.isclose(tails.chi2_tail(x, 2), math.exp(-x / 2), rel_tol=1e-12)
        assert math.isclose(tails.chi2_tail(x, 4), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-12)
    for t in (0.3, 1.0, 12.0):
        assert math.isclose(tails.t_two_sided(t, 1), 1 - 2 / math.pi * math.atan(t), rel_tol=1e-10)
        assert math.isclose(tails.t_two_sided(t, 2), 1 - t / math.sqrt(2 + t * t), rel_tol=1e-10)
        assert math.isclose(tails.f_tail(t * t, 1, 9), tails.t_two_sided(t, 9), rel_tol=1e-10)


def test_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, "b"), (3, "a"), (4, "b"), (5, "a"), (60, "c"), (None, None)], "n long, cat string")
    assert {r["column"]: (r["nulls"], r["distinct"]) for r in profile.column_counts(df, exact=True).collect()} == {"n": (1, 6), "cat": (1, 3)}
    bins = profile.histograms(df).orderBy("bin").collect()
    assert len(bins) == 10 and sum(r["n"] for r in bins) == 6 and bins[9]["hi"] == 60
    assert [(r["value"], r["n"]) for r in profile.top_values(df).orderBy(F.desc("n"), "value").collect()] == [("b", 3), ("a", 2), ("c", 1)]
    seven = spark.createDataFrame([(7,)] * 3, "k long")
    assert [(r["bin"], r["n"]) for r in profile.histograms(seven).collect()] == [(0, 3)]
    assert set(profile.profile(df, max_rows=3)) == {"counts", "numeric", "histograms", "top"}


def test_governed_aggregates_never_return_a_row(spark):
    df = spark.createDataFrame([("SENTINEL", "a", 1), ("x", "a", 2), ("y", "b", 3)], "customer string, region string, spend long")
    out = profile.governed_aggregate(df, [("sum", "spend"), ("count", "*")], ["region"], min_group_size=2)
    assert [tuple(r) for r in out.collect()] == [("a", 3, 2)]
    for bad in ([], [("list", "customer")], [("sum", "*")]):
        with pytest.raises(ValueError):
            profile.governed_aggregate(df, bad)


def test_roles(spark):
    df = spark.sql("select * from values (1.0D, true, 'a', 'r1', 1, timestamp'2024-01-01', array(1), cast(null as int)), (2.5D, false, 'a', 'r2', 1, timestamp'2024-01-02', array(2), null), (double('nan'), true, 'b', 'r3', 1, timestamp'2024-01-03', array(2), null), (4.0D, true, 'b', 'r4', 1, timestamp'2024-01-04', null, null) t(value, flag, grp, row_id, constant, at, nested, none)")
    roles = {r["column"]: (r["role"], r["reason"] is None) for r in profile.classify(df).collect()}
    assert [roles[c][0] for c in df.columns] == ["numeric", "numeric", "categorical", "excluded", "excluded", "excluded", "excluded", "excluded"]
    assert all((role == "excluded") != no_reason for role, no_reason in roles.values())


def test_pearson_and_spearman(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, 200).astype(float), rng.normal(size=200)
    y = y + 0.1 * x
    df = frame(spark, x=x, y=y).union(spark.createDataFrame([(None, 1.0), (2.0, float("nan"))], "x double, y double")).withColumn("k", F.lit(1))
    t = pairs.pearson_tests(df, ["x", "y", "k"])[0]
    r = np.corrcoef(x, y)[0, 1]
    assert (t.n, t.a, t.b) == (200, "x", "y") and math.isclose(t.statistic, r, rel_tol=1e-10) and len(pairs.pearson_tests(df, ["x", "k"])) == 0

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    want = np.corrcoef(ranks(x), ranks(y))[0, 1]
    for parts in (1, 7):
        got = pairs.spearman(df.repartition(parts), "x", "y").first()
        assert got["n"] == 200 and math.isclose(got["rho"], want, rel_tol=1e-10)


def test_anova_and_chi_square(spark):
    rng = np.random.default_rng(1)
    g = np.array(["a", "b", "c"])[rng.integers(0, 3, 120)]
    v = rng.normal(size=120) + (g == "a") * 2
    df = frame(spark, g=g, v=v).union(spark.createDataFrame([("rare", 99.0), ("rare", 98.0), (None, 1.0)], "g string, v double"))
    t = pairs.anova_tests(df, ["v"], ["g"])[0]
    grand = v.mean()
    between = sum((g == k).sum() * (v[g == k].mean() - grand) ** 2 for k in "abc")
    within = sum(((v[g == k] - v[g == k].mean()) ** 2).sum() for k in "abc")
    assert t.n == 120 and math.isclose(t.statistic, between / 2 / (within / 117), rel_tol=1e-9) and math.isclose(t.effect, between / (between + within), rel_tol=1e-9)
    assert math.isclose(t.p_value, (1 + 2 * t.statistic / 117) ** (-117 / 2), rel_tol=1e-9)
    independent = spark.createDataFrame([(a, b) for a in "xy" for b in "pq" for _ in range(30)], "a string, b string")
    t = pairs.chi_square_tests(independent, ["a", "b"])[0]
    assert t.statistic == 0 and t.p_value == 1 and t.detail["dof"] == 1
    counted = {("x", "p"): 10, ("x", "q"): 20, ("y", "p"): 30, ("y", "q"): 5}
    t = pairs.chi_square_tests(spark.createDataFrame([pair for pair, n in counted.items() for _ in range(n)], "a string, b string"), ["a", "b"])[0]
    cells, expected = np.array([[10, 20], [30, 5]]), np.array([[40 * 30 / 65, 25 * 30 / 65], [40 * 35 / 65, 25 * 35 / 65]])
    assert t.detail["dof"] == 1 and math.isclose(t.statistic, ((np.abs(cells - expected) - 0.5) ** 2 / expected).sum(), rel_tol=1e-12)


def test_missing_cells_count(spark):
    rng = np.random.default_rng(8)
    for levels in (2, 3, 9):
        a, b = rng.integers(0, levels, 60), rng.integers(0, levels, 60)
        b = np.where(a == 0, 0, b)  # the first row has one cell only
        table = np.zeros((levels, levels))
        np.add.at(table, (a, b), 1)
        table = table[table.sum(axis=1) > 0][:, table.sum(axis=0) > 0]
        expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()
        off = np.abs(table - expected)
        want = ((off - np.minimum(0.5, off) * (table.shape == (2, 2))) ** 2 / expected).sum()
        t = pairs.chi_square_tests(spark.createDataFrame([(f"a{x}", f"b{y}") for x, y in zip(a, b, strict=True)], "a string, b string"), ["a", "b"])[0]
        assert math.isclose(t.statistic, want, rel_tol=1e-10) and t.detail["dof"] == (table.shape[0] - 1) * (table.shape[1] - 1)


def test_many_levels_stay_on_the_executors(spark):
    df = spark.range(1_000_000).select((F.col("id") % 250_000).alias("level"), (F.hash("id") % 100).cast("double").alias("v"), (F.col("id") % 2).alias("half"))
    t = pairs.anova_tests(df, ["v"], ["level"])[0]
    assert t.n == 1_000_000 and t.detail == {"levels": 250_000}
    t = pairs.chi_square_tests(df, ["level", "half"])[0]
    assert t.detail["dof"] == 249_999 and math.isclose(t.effect, 1.0) and math.isclose(t.statistic, 1e6, rel_tol=1e-9)


def test_rho_is_that_of_each_pairs_rows(spark):
    rng = np.random.default_rng(6)
    columns = {c: np.where(rng.random(160) < hole, np.nan, rng.integers(0, 9, 160) + 0.3 * k) for k, (c, hole) in enumerate({"a": 0, "b": 0.2, "c": 0.2, "d": 0, "e": 0.5}.items())}
    columns["f"] = np.where(np.isnan(columns["b"]), np.nan, columns["a"] ** 2)  # missing where b is
    df = frame(spark, **columns).repartition(5)
    found = {(t.a, t.b): t for t in pairs.pearson_tests(df, list(columns))}
    assert len(found) == 15

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for (a, b), t in found.items():
        both = ~np.isnan(columns[a]) & ~np.isnan(columns[b])
        x, y = columns[a][both], columns[b][both]
        assert t.n == both.sum() and math.isclose(t.statistic, np.corrcoef(x, y)[0, 1], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(t.detail["rho"], np.corrcoef(ranks(x), ranks(y))[0, 1], rel_tol=1e-9, abs_tol=1e-12)


def test_false_discovery(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.5]
    q, keep = pairs.benjamini_hochberg(p)
    want = [min(1, min(p[j] * 11 / (j + 1) for j in range(i, 11))) for i in range(11)]
    assert np.allclose(q, want) and keep == [x <= 0.05 for x in want]
    df = spark.createDataFrame([(x,) for x in reversed(p)], "p_value double")
    assert np.allclose(sorted(r["q_value"] for r in pairs.with_q_values(df).collect()), sorted(q))
    assert pairs.benjamini_hochberg([]) == ([], [])


def test_linear_fit_to_twelve_digits(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(1, 50, 300)
    y = 3 + 1.7 * x + rng.normal(0, 5, 300)
    f = next(f for f in regression.ladder(frame(spark, x=x, y=y), "y", ["x"]) if f.form == "linear")
    r2 = np.corrcoef(x, y)[0, 1] ** 2
    assert abs(f.r2 - r2) < 1e-12 and abs(f.adj_r2 - (1 - (1 - r2) * 299 / 298)) < 1e-12 and math.isclose(f.std_coefficient, math.sqrt(r2), rel_tol=1e-9)


def test_exponential_fit_states_r2_on_the_original_scale(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(1, 10, 400)
    y = np.exp(0.35 * x + rng.normal(0, 0.15, 400))
    fits = {f.form: f for f in regression.ladder(frame(spark, x=x, y=y), "y", ["x"])}
    b, a = np.polyfit(x, np.log(y), 1)
    want = 1 - ((np.exp(a + b * x) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert math.isclose(fits["log-y"].r2, want, rel_tol=1e-9) and fits["log-y"].caveat
    c = np.polyfit(x, y, 2)
    r2 = 1 - ((np.polyval(c, x) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    q = fits["quadratic"]
    assert math.isclose(q.r2, r2, rel_tol=1e-9) and np.allclose([q.coefficients["x^2"], q.coefficients["x"], q.coefficients["intercept"]], c, rtol=1e-6)
    assert "log-y" not in {f.form for f in regression.ladder(frame(spark, x=x, y=y - 5), "y", ["x"])}


def test_categorical_fit(spark):
    rng = np.random.default_rng(4)
    g = np.array(["b", "a", "c"])[rng.integers(0, 3, 150)]
    v = rng.normal(size=150) + (g == "c")
    f = regression.categorical_fits(frame(spark, g=g, v=v), "v", ["g"])[0]
    assert math.isclose(f.coefficients["intercept"], v[g == "a"].mean(), rel_tol=1e-9) and math.isclose(f.coefficients["g_c"], v[g == "c"].mean() - v[g == "a"].mean(), rel_tol=1e-9)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    a, b, n1, n2 = rng.normal(size=(4, 500))
    g = np.array(["u", "v"])[rng.integers(0, 2, 500)]
    return frame(spark, y=4 * a - 2 * b + rng.normal(0, 0.5, 500), a=a, b=b, noise1=n1, noise2=n2, g=g), (a, b)


def test_stepwise_model_finds_the_planted_drivers(planted):
    df, _ = planted
    m, columns = model.fit_multivariate(df, "y", ["a", "b", "noise1", "noise2"], ["g"])
    assert m.predictors[:2] == ["a", "b"] and abs(m.coefficients["a"] - 4) < 0.1 and m.adj_r2 > 0.97 and "a" not in m.weak and "b" not in m.weak
    rows = df.select("y", *m.predictors).toPandas() if set(m.predictors) <= set(df.columns) else None
    if rows is not None:
        x = np.column_stack([np.ones(500), rows[m.predictors]])
        w, ssr, *_ = np.linalg.lstsq(x, rows["y"], rcond=None)
        assert np.allclose([m.coefficients["intercept"], *(m.coefficients[p] for p in m.predictors)], w, rtol=1e-9)
        assert math.isclose(m.r2, 1 - ssr[0] / ((rows["y"] - rows["y"].mean()) ** 2).sum(), rel_tol=1e-10)
        assert math.isclose(m.bic, 500 * (math.log(2 * math.pi) + math.log(ssr[0] / 500) + 1) + len(w) * math.log(500), rel_tol=1e-10)
    d = model.diagnose(df, m, columns)
    assert d.n == 500 and d.spread_p > 0.001 and 0 <= d.influential < 60


def test_twins_are_noted_and_spread_is_found(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=400)
    twin = a + rng.normal(0, 0.01, 400)
    names = ["a", "twin", "y"]
    y = a + 0.5 * twin + rng.normal(0, 0.01, 400)
    g = model.gram(frame(spark, a=a, twin=twin, y=y), [pairs.number(c) for c in names])
    n, mean, s = g.total()
    assert np.allclose(s, np.cov(np.stack([a, twin, y])) * 399, rtol=1e-9)
    m = model.solved(s, mean, n, [0, 1], 2, names, "y")
    assert m.vif["a"] > 10 and m.notes
    x = rng.uniform(1, 5, 400)
    uneven = frame(spark, x=x, y=2 * x + x * rng.normal(size=400))
    fit, columns = model.fit_multivariate(uneven, "y", ["x"], [])
    d = model.diagnose(uneven, fit, columns)
    assert d.spread_p < 0.01 and d.verdict != "good"


def test_pca(spark):
    rng = np.random.default_rng(7)
    f1, f2 = rng.normal(size=(2, 400))
    cols = {"a": f1, "b": f1, "c": f1, "d": f2, "e": f2}
    df = frame(spark, **{k: v + rng.normal(0, 0.3, 400) for k, v in cols.items()})
    p = model.run_pca(df, list(cols))
    assert p.explained[0] + p.explained[1] > 0.85 and set(p.drivers[0]) == {"a", "b", "c"} and set(p.drivers[1]) == {"d", "e"}
    scores = model.pca_scores(df, p).select("pc1", "pc2").toPandas()
    assert abs(np.corrcoef(scores["pc1"], scores["pc2"])[0, 1]) < 1e-9
    assert model.run_pca(df, ["a", "b"]) is None


@pytest.fixture(scope="module")
def tutorial(spark):
    rng = np.random.default_rng(7)
    n = 1095
    days = np.datetime64("2023-01-01") + np.arange(n)
    temp = 15 + 12 * np.sin(np.arange(n) * 2 * np.pi / 365) + rng.normal(0, 3, n)
    school, ads = (rng.random(n) < 0.2).astype(int), rng.gamma(2, 25, n)
    sales = np.round(40 + 9.5 * np.maximum(temp, 0) + 120 * school + 0.6 * ads + rng.normal(0, 35, n)).astype(int)
    return frame(
        spark, date=[str(d) for d in days], temperature_c=temp, humidity_pct=70 - 0.4 * temp + rng.normal(0, 12, n), school_out=school, ad_spend=ads,
        website_visits=np.round(200 + 3.5 * ads + rng.normal(0, 60, n)).astype(int), competitor_promo=(rng.random(n) < 0.2).astype(int), lottery_numbers=rng.integers(1, 50, n), daily_sales=sales,
    ).withColumn("date", F.to_date("date"))


def test_scan_finds_planted_truth_and_no_decoys(spark, tutorial, tmp_path):
    s = scan.scan(tutorial, "daily_sales", name="tutorial")
    assert s.roles["date"][0] == "excluded" and [f.predictor for f in s.drivers[:2]] == ["temperature_c", "school_out"] and s.drivers[0].adj_r2 > 0.6
    assert {"temperature_c", "school_out", "ad_spend"} <= set(s.model.predictors) and s.model.adj_r2 > 0.85
    decoys = {"competitor_promo", "lottery_numbers"}
    assert not any(set(f.columns) == {d, "daily_sales"} for f in s.findings for d in decoys)
    assert s.pca and s.diagnostics.verdict in ("good", "caution", "poor")
    assert not any(word in f.headline for f in s.findings for word in ("cause", "because"))
    n = scan.save_findings(spark, s, str(tmp_path / "f"))
    scan.save_findings(spark, s, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2 * n
    with pytest.raises(ValueError, match="date"):
        scan.scan(tutorial, "date")
    part = scan.scan(tutorial, None, max_rows=300)
    assert part.sampled and part.n_rows == 1095 and part.model is None


def test_one_pass_says_what_the_single_tests_say(spark):
    """The scan's tests, drivers and model against those made one by one, with values missing here and there and levels in some rows only."""
    rng = np.random.default_rng(21)
    n = 700
    a, b = rng.uniform(1, 9, n), rng.normal(size=n)
    g = np.array(["x", "y", "z"])[rng.integers(0, 3, n)]
    h = np.array(["p", "q"])[(rng.random(n) < 0.3 + 0.2 * (g == "x")).astype(int)]
    y = np.exp(0.2 * a) + (g == "z") * 2 + rng.normal(0, 0.2, n) + 3
    holes = lambda v: np.where(rng.random(n) < 0.1, np.nan, v)
    df = frame(spark, y=holes(y), a=holes(a), b=b, flag=rng.random(n) < 0.5, g=g, h=h).withColumn("g", F.when(F.col("b") < 1.5, F.col("g"))).repartition(5)
    numeric, categorical = ["y", "a", "b", "flag"], ["g", "h"]
    got = scan.scan(df, "y")
    want = pairs.all_pairs(profile.without_nan(df), numeric, categorical)
    assert [(t.a, t.b, t.kind, t.n, t.direction) for t in got.tests] == [(t.a, t.b, t.kind, t.n, t.direction) for t in want] and len(want) == 15
    for x, w in zip(got.tests, want, strict=True):
        assert np.allclose([x.statistic, x.p_value, x.effect], [w.statistic, w.p_value, w.effect], rtol=1e-8, atol=1e-12)
        assert set(x.detail) == set(w.detail)
        if "rho" in w.detail:
            assert math.isclose(x.detail["rho"], w.detail["rho"], rel_tol=1e-9, abs_tol=1e-12)
    fits = regression.best_fits(profile.without_nan(df), "y", numeric, categorical)
    assert [(f.predictor, f.form, f.n) for f in got.drivers] == [(f.predictor, f.form, f.n) for f in fits]
    assert np.allclose([f.adj_r2 for f in got.drivers], [f.adj_r2 for f in fits], rtol=1e-8)
    made, columns = model.fit_multivariate(profile.without_nan(df), "y", numeric, categorical)
    assert got.model.predictors == made.predictors and got.model.n == made.n
    assert np.allclose(list(got.model.coefficients.values()), list(made.coefficients.values()), rtol=1e-7)
    d = model.diagnose(profile.without_nan(df), made, columns)
    assert np.allclose([got.diagnostics.jarque_bera, got.diagnostics.breusch_pagan, got.diagnostics.influential], [d.jarque_bera, d.breusch_pagan, d.influential], rtol=1e-6)
    assert np.allclose(got.pca.explained, model.run_pca(profile.without_nan(df), numeric).explained, rtol=1e-9)


def test_models_of_many_levels_are_those_of_all_cross_products(spark, monkeypatch):
    rng = np.random.default_rng(33)
    n = 900
    level, other, x, z = rng.integers(0, 40, n), rng.integers(0, 6, n), rng.normal(size=n), rng.normal(size=n)
    y = 2 * x + 4 * (level == 7) - 3 * (level == 21) + 1.5 * (other == 2) + (level == 7) * (other == 3) + rng.normal(0, 0.7, n)
    df = frame(spark, y=y, x=np.where(rng.random(n) < 0.05, np.nan, x), z=z, g=np.array([f"l{v:02d}" for v in level]), h=np.array([f"o{v}" for v in other])).withColumn("h", F.when(F.col("z") < 2, F.col("h"))).repartition(4)
    want, columns = model.fit_multivariate(df, "y", ["x", "z"], ["g", "h"])
    checked = model.diagnose(df, want, columns)
    monkeypatch.setattr(model, "DENSE_LEVELS", 3)
    got, columns = model.fit_multivariate(df, "y", ["x", "z"], ["g", "h"])
    assert got.predictors == want.predictors and got.n == want.n and {"x", "g_l07", "g_l21", "h_o2"} <= set(got.predictors)
    for part in ("coefficients", "p_values", "std_coefficients", "vif"):
        assert np.allclose([getattr(got, part)[c] for c in getattr(want, part)], list(getattr(want, part).values()), rtol=1e-7, atol=1e-12)
    assert math.isclose(got.bic, want.bic, rel_tol=1e-10) and model.diagnose(df, got, columns).verdict == checked.verdict


def test_a_model_with_ten_thousand_levels(spark):
    df = spark.range(60_000).select((F.col("id") % 10_000).alias("g"), (F.hash("id") % 1000 / 1000.0).alias("x"))
    df = df.withColumn("y", F.expr("3 * x + if(g = 77, 40, 0) - if(g = 4321, 30, 0) + hash(x, g) % 100 / 1000.0"))
    made, _ = model.fit_multivariate(df, "y", ["x"], ["g"])
    assert set(made.predictors[:3]) == {"x", "g_77", "g_4321"}
    assert abs(made.coefficients["g_77"] - 40) < 0.1 and abs(made.coefficients["g_4321"] + 30) < 0.1 and abs(made.coefficients["x"] - 3) < 0.01
