"""Relational steps, flows, sinks: the literal cases of their semantics."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import nodes
from loomwork.plans import flow
from loomwork.sources import files
from loomwork.streaming import rowwise


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([("West", "ann", 100), ("West", "bob", 50), ("East", "ann", 20), ("East", None, 7)], "region string, rep string, sales long")


@pytest.fixture(scope="module")
def quota(spark):
    return spark.createDataFrame([("West", 120), ("East", 30)], "region string, quota long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_select_casts_old_names_then_renames(orders):
    df = nodes.select(orders, keep=["SALES", "region"], cast={"sales": "string"}, rename={"sales": "amount"})
    assert df.dtypes == [("amount", "string"), ("region", "string")]
    assert nodes.select(orders, drop=["rep"]).columns == ["region", "sales"]
    with pytest.raises(ValueError, match="no column 'x'"):
        nodes.select(orders, keep=["x"])
    with pytest.raises(ValueError):
        nodes.select(orders, keep=["rep"], drop=["rep"])


def test_filter_drops_null_conditions(orders):
    assert rows(nodes.filter_rows(orders, "rep <> 'bob'")) == [("East", "ann", 20), ("West", "ann", 100)]


def test_calculated_refuses_a_clash(orders):
    assert "double_it" in nodes.calculated(orders, "double_it", "sales * 2").columns
    with pytest.raises(ValueError):
        nodes.calculated(orders, "Sales", "1")


def test_clean_nulls(spark, orders):
    assert nodes.clean_nulls(orders, "drop", ["rep"]).count() == 3
    assert rows(nodes.clean_nulls(orders, "fill", ["rep"], "none"))[0] == ("East", "ann", 20)
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    assert nodes.drop_nulls(nan, ["v"]).count() == 2
    filled = nodes.fill_nulls(nan, ["v"], "2.5").collect()
    assert sorted(str(r["v"]) for r in filled) == ["1.0", "2.5", "nan"]
    with pytest.raises(ValueError):
        nodes.clean_nulls(orders, "fill", ["rep"])


def test_aggregate(orders):
    assert rows(nodes.aggregate(orders, ["rep"], ["sum(sales) AS s"])) == [("ann", 120), ("bob", 50), (None, 7)]
    assert rows(nodes.aggregate(orders, [], ["count(*) AS n"])) == [(4,)]


def test_joins(spark, orders, quota):
    same = nodes.join(orders, quota, ["region"])
    assert same.columns == ["region", "rep", "sales", "quota"] and same.count() == 4
    full = nodes.join(orders.filter("region = 'West'"), quota, ["region"], how="full")
    assert ("East", None, None, 30) in rows(full)
    null = spark.createDataFrame([(None, 1)], "region string, quota long")
    assert nodes.join(null, null, ["region"]).count() == 0
    other = quota.withColumnRenamed("region", "zone").withColumn("Sales", F.lit(1)).withColumn("sales_1", F.lit(2))
    clash = nodes.join(orders, other, ["region"], ["zone"], hint="broadcast")
    assert clash.columns == ["region", "rep", "sales", "zone", "quota", "Sales_2", "sales_1"]
    with pytest.raises(ValueError):
        nodes.join(orders, quota, ["region"], how="cross")


def test_union_matches_names_and_widens_to_text(spark, orders):
    other = spark.createDataFrame([(5, "North")], "SALES int, region string")
    assert nodes.union(orders, other).filter("region = 'North'").first()["rep"] is None
    text = spark.createDataFrame([("many", "x")], "sales string, region string")
    assert dict(nodes.union(orders, text).dtypes)["sales"] == "string"
    assert nodes.union(orders, orders).count() == 8


def test_pivot_and_back(spark, orders):
    wide = nodes.pivot(orders, "rep", ["sum(sales)"], ["region"])
    assert wide.columns == ["region", "ann", "bob"] and rows(wide) == [("East", 20, None), ("West", 100, 50)]
    assert nodes.pivot(orders, "rep", ["sum(sales)"]).columns == ["region", "ann", "bob"]
    only_null = spark.createDataFrame([("N", None, 1)], "region string, rep string, sales long")
    assert nodes.pivot(orders.union(only_null), "rep", ["sum(sales) AS s", "count(1) AS n"], ["region"]).count() == 3
    long = nodes.unpivot(wide, ["ann", "bob"], "rep", "sales")
    assert rows(long) == [("East", "ann", 20), ("West", "ann", 100), ("West", "bob", 50)]


def test_pivots_of_any_number_of_values(spark):
    values = 50_000
    df = spark.range(values).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("g"), F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    df = df.unionByName(spark.createDataFrame([("none", None, 1), (None, 7, 5), ("even", None, 9)], "g string, k long, v long"))
    cells = nodes.pivot_cells(df, "k", ["sum(v) AS s"], ["g"])
    assert cells.columns == ["g", "k", "position", "s"] and cells.count() == values + 2
    assert cells.filter("k is not null").filter("position <> k").count() == 0
    assert [tuple(r) for r in cells.filter("k is null").collect()] == [("none", None, None, None)]
    part = nodes.pivot_slice(cells, "k", ["g"], 49_998, 1000)
    assert part.columns == ["g", "49998", "49999"]
    assert rows(part) == sorted([("even", 149994, None), ("odd", None, 149997), ("none", None, None), (None, None, None)], key=repr)
    narrow = nodes.pivot_slice(nodes.pivot_cells(df.filter("k < 10 or k is null"), "k", ["sum(v) AS s", "count(1) AS n"], ["g"]), "k", ["g"], 0)
    assert rows(narrow.select("g", "7_s", "7_n", "0_s")) == rows(nodes.pivot(df.filter("k < 10 or k is null"), "k", ["sum(v) AS s", "count(1) AS n"], ["g"]).select("g", "7_s", "7_n", "0_s"))
    assert nodes.pivot_cells(df.limit(0), "k", ["sum(v) AS s"], ["g"]).count() == 0
    assert [tuple(r) for r in nodes.pivot_cells(df.filter("k is null"), "k", ["sum(v) AS s"], []).collect()] == [(None, None, None)]
    with pytest.raises(ValueError):
        nodes.pivot_cells(df.withColumnRenamed("g", "position"), "k", ["sum(v) AS s"], ["position"])


def test_outliers(spark):
    spikes = spark.createDataFrame([(v,) for v in (10, 11, 9, 10, 12, 900)] + [(None,)], "v long")
    flagged = nodes.outliers(spikes, "v")
    assert [r["v"] for r in flagged.collect() if r["is_outlier"]] == [900]
    assert nodes.outliers(spikes, "v", action="remove").count() == 6
    assert nodes.outliers(spikes, "v", "zscore", 1.5, "remove").count() == 6
    assert nodes.outliers(spark.createDataFrame([(1,), (1,)], "v int"), "v", "zscore").filter("is_outlier").count() == 0
    with pytest.raises(ValueError):
        nodes.outliers(spikes, "v", "mad")


def test_sample_is_exact_and_independent_of_partitions(spark):
    many = spark.range(1000)
    picked = [sorted(r["id"] for r in nodes.sample(many.repartition(k), 25, 7).collect()) for k in (1, 7)]
    assert len(picked[0]) == 25 and picked[0] == picked[1]
    assert nodes.sample(many, 25, 8).exceptAll(nodes.sample(many, 25, 7)).count() > 0
    assert nodes.sample(spark.range(3), 10).count() == 3
    assert nodes.sample(spark.sql("select map('a', 1) as m, array(map(1, 2)) as n"), 1).count() == 1


def acceptance_flow(path):
    f = flow.Flow()
    f.add("w", "input_dataset", {"name": "orders_west"}).add("e", "input_dataset", {"name": "orders_east"}).add("q", "input_dataset", {"name": "quota"})
    f.add("all", "union").connect("w", "all", 0).connect("e", "all", 1)
    f.add("clean", "clean_nulls", {"mode": "drop", "columns": ["rep"]}).connect("all", "clean")
    f.add("joined", "join", {"left_on": ["region"], "how": "left"}).connect("clean", "joined", 0).connect("q", "joined", 1)
    f.add("share", "calculated", {"name": "share", "expression": "sales / quota"}).connect("joined", "share")
    f.add("wide", "pivot", {"on": "region", "using": ["sum(sales)"], "group_by": ["rep"]}).connect("share", "wide")
    f.add("out", "output", {"path": path}).connect("wide", "out").add("out2", "output", {"path": path + ".csv", "format": "csv"}).connect("share", "out2")
    return f


@pytest.fixture(scope="module")
def views(spark, quota):
    spark.createDataFrame([("West", "ann", 100), ("West", "bob", 50), ("West", None, 1)], "region string, rep string, sales long").createOrReplaceTempView("orders_west")
    spark.createDataFrame([("East", "ann", 20), ("East", "cy", 7)], "region string, rep string, sales long").createOrReplaceTempView("orders_east")
    quota.createOrReplaceTempView("quota")


def test_acceptance_flow(spark, views, tmp_path):
    f = flow.Flow.from_doc(acceptance_flow(str(tmp_path / "o")).to_doc())
    assert f.frame(spark, "joined").count() == 4 and f.frame(spark, "wide").count() == 3
    reports = flow.run_outputs(spark, f, dry_run=True)
    assert reports["out"].written == 0 and reports["out"].skipped == 3
    reports = flow.run_outputs(spark, f)
    assert (reports["out"].written, reports["out2"].written) == (3, 4)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert files.read_file(spark, str(tmp_path / "o.csv")).count() == 4
    schema, total, first = flow.preview(spark, f, "share", 2)
    assert schema[-1] == ("share", "double") and total == 4 and first.count() == 2
    assert set(flow.profile_node(spark, f, "share")) == {"counts", "numeric", "histograms", "top"}


def test_flow_faults_name_the_node(spark, views):
    f = flow.Flow().add("a", "input_dataset", {"name": "quota"}).add("b", "filter", {"expression": "quota > 1"}).connect("a", "b")
    for call, text in (
        (lambda: f.add("c", "nope"), "unknown type"), (lambda: f.add("a", "filter"), "twice"), (lambda: f.connect("a", "b"), "taken"), (lambda: f.connect("a", "b", 1), "no input 1"),
        (lambda: flow.Flow().add("x", "filter").add("y", "filter").connect("x", "y").connect("y", "x"), "circle"), (lambda: f.connect("a", "zz"), "zz"),
        (lambda: flow.Flow().add("x", "filter", {"expression": "1"}).frame(spark, "x"), "needs 1 input"), (lambda: flow.Flow.from_doc({"schema": 9}), "newer"),
    ):
        with pytest.raises(ValueError, match=text):
            call()
    with pytest.raises(ValueError, match="'s'.*wrong"):
        flow.Flow().add("a", "input_dataset", {"name": "quota"}).add("s", "select", {"wrong": 1}).connect("a", "s").frame(spark, "s")
    with pytest.raises(ValueError, match="node 's'.*no column"):
        flow.Flow().add("a", "input_dataset", {"name": "quota"}).add("s", "select", {"keep": ["zz"]}).connect("a", "s").frame(spark, "s")


def test_destructive_outputs_are_refused_before_anything_runs(spark, views, tmp_path):
    f = flow.Flow().add("a", "input_dataset", {"name": "quota"}).add("o", "output", {"path": str(tmp_path / "x")}).connect("a", "o")
    f.add("t", "output_dataset", {"table": "quota_copy"}).connect("a", "t")
    with pytest.raises(PermissionError, match="t"):
        flow.run_outputs(spark, f)
    assert not (tmp_path / "x").exists()
    assert flow.run_outputs(spark, f, only=["o"])["o"].written == 2
    assert flow.run_outputs(spark, f, allow_writes=True)["t"].written == 2
    assert spark.table("quota_copy").count() == 2


def test_generated_flows_and_own_nodes(spark, orders, tmp_path):
    path = str(tmp_path / "in.parquet")
    orders.write.parquet(path)
    f = flow.flow_from_columns(path, ["rep"], str(tmp_path / "out"))
    assert flow.run_outputs(spark, f)["out"].written == 4
    doc = {"fields": [{"target": "who", "sources": ["rep"], "steps": [{"key": "lookup", "args": {"pairs": [["ann", "A"], ["ann", "B"]]}}]}]}
    report = flow.run_outputs(spark, flow.flow_with_mapping(path, doc, str(tmp_path / "out2")))["out"]
    assert report.written == 4 and "repeat a key" in report.notes[0]
    if "twice" not in flow.NODE_TYPES:
        flow.register_node("twice", lambda df, times=2: df.limit(1).select(F.lit(times).alias("n")))
    f.add("own", "twice", {"times": 5}).connect("select", "own")
    assert f.frame(spark, "own").first()["n"] == 5
    with pytest.raises(ValueError):
        flow.register_node("twice", lambda df: df)


def test_row_wise_steps_run_on_streams(spark, orders, tmp_path):
    path = str(tmp_path / "events")
    orders.write.parquet(path)
    stream = spark.readStream.schema(orders.schema).parquet(path)
    steps = [("filter", {"expression": "sales > 10"}), ("calculated", {"name": "tenth", "expression": "sales / 10"}), ("clean_nulls", {"mode": "drop", "columns": ["rep"]})]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    rowwise.write_stream(rowwise.apply_steps(stream, steps), out, check).awaitTermination(60)
    assert rows(spark.read.parquet(out)) == rows(rowwise.apply_steps(orders, steps))
    orders.limit(2).write.mode("append").parquet(path)
    rowwise.write_stream(rowwise.apply_steps(stream, steps), out, check).awaitTermination(60)
    assert spark.read.parquet(out).count() > 3
    with pytest.raises(ValueError):
        rowwise.apply_steps(stream, [("sample", {})])
