"""JSON and HTML sources, databases, push plans, charts, and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork import queries
from loomwork.operators import charts
from loomwork.sources import files, pages, push, records


def test_json_paths(spark):
    """Bell towers of a valley: lists in lists, a tower without bells, a body that is cut off."""
    valley = '{"valley":"Enn","towers":[{"bells":[{"kg":310,"cast":{"by":"Oda","in":[1702,1711]}},{"kg":95.5}],"steps":64},{"bells":[],"steps":7}]}'
    docs = records.parse_documents(spark.createDataFrame([(valley,), ('{"valley":"Ost","towers":null}',), ('{"valley":',)], "sheet string"), "sheet")
    bells = records.to_table(docs, "towers[0].bells", {"weight": "kg", "founder": "cast.by", "recast": "cast.in[-1]", "cast": "cast", "pitch": "tone.hz[2]"}, "sheet")
    assert sorted(map(tuple, bells.collect()), key=repr) == [(310.0, "Oda", 1711, '{"by":"Oda","in":[1702,1711]}', None), (95.5, None, None, None, None)]
    whole = records.to_table(docs, "", {"name": "valley", "steps": "towers.steps", "each": "towers[*].steps", "low": "towers[-1].steps", "third": "towers[2].steps"}, "sheet")
    assert ("Enn", "[64,7]", "[64,7]", 7, None) in list(map(tuple, whole.collect()))
    assert records.parse_path("m[3][*].n.o[-2]") == ["m", 3, "*", "n", "o", -2]
    with pytest.raises(ValueError):
        records.parse_path("m[one]")


def test_json_inference_and_flattening(spark, tmp_path):
    """A log of a hut's birds: a list under a customary name, though another is longer; then one where length decides."""
    hut = '{"season":9,"rows":[{"bird":"wren","seen":{"from":{"hut":3,"path":"low"},"times":[5,8]}}],"guests":[{"n":1},{"n":2},{"n":4}]}'
    docs = records.parse_documents(spark.createDataFrame([(hut,)], "sheet string"), "sheet")
    path, columns = records.infer_mapping(docs, "sheet")
    assert path == "rows" and columns["seen_from_hut"] == "seen.from.hut" and columns["bird"] == "bird"
    flat = records.to_table(docs, path, None, "sheet")
    assert flat.columns == ["bird", "seen.from.hut", "seen.from.path", "seen.times"] and flat.first()["seen.times"] == "[5,8]"
    tide = spark.read.json(spark.createDataFrame([('{"p":{"q":{"r":{"s":{"t":[true]}}}},"u":0}',)], "v string").rdd.map(lambda r: r[0]))
    assert records.to_table(tide).first().asDict() == {"p.q.r.s": '{"t":[true]}', "u": 0}
    lengths = records.parse_documents(spark.createDataFrame([('{"oars":[{"cm":1}],"ropes":[{"cm":1},{"cm":2}],"mast":{"cm":9}}',)], "sheet string"), "sheet")
    assert records.infer_mapping(lengths, "sheet")[0] == "ropes"


#: A harbour's page: a header of two rows whose second one names the halves of the tide, a cell that spans rows, a table too small to count, one without a caption under a heading.
HARBOUR = """<html><head><title>Pilot's notes</title></head><body><h3>Depths &amp; tides[c]</h3>
<table><thead><tr><th>Buoy</th><th colspan="2">Tide [m]</th><th>Lit</th></tr><tr><th>Buoy</th><th>low</th><th>low</th><th>Lit</th></tr></thead>
<caption>Soundings [7] off the pier</caption><tr><td rowspan="3">North</td><td>1.5[b]</td><td>1.7</td><td>yes</td></tr><tr><td>0.9</td><td>1.1</td><td>no</td></tr>
<tr><td>0.2</td><td>0.4</td><td>no</td></tr></table><table><tr><td>only one row</td><td>here</td></tr></table>
<footer><table><tr><td>a</td></tr><tr><td>b</td></tr></table></footer><h4>Dues</h4><table><tr><td>yawl</td><td>12</td></tr><tr><td>barge</td></tr></table></body></html>"""
NOTICE = "<style>p{}</style><h1>Ebb <i>and</i> flow</h1><script>document.write('<p>ad</p>')</script><header><p>menu</p></header><p>The bar dries.<p>Keep <em>east</em></p>"


def test_html_tables(spark):
    df = spark.createDataFrame([(7, "https://quay.example/charts/North_Pier.2/", HARBOUR), (8, "https://quay.example", NOTICE), (9, "w", None)], "page_id int, url string, html string")
    tables = {}
    for r in pages.extract_tables(df).orderBy("table_index", "row_index").collect():
        tables.setdefault((r[0], r[2]), []).append(r[4])
    depths = [{"Buoy": "North", "Tide low": low, "Tide low_2": high, "Lit": lit} for low, high, lit in (("1.5", "1.7", "yes"), ("0.9", "1.1", "no"), ("0.2", "0.4", "no"))]
    assert tables == {(7, "Soundings off the pier"): depths, (7, "Dues"): [{"0": "yawl", "1": "12"}, {"0": "barge", "1": ""}]}
    named = {tuple(r)[:2] + (r[3],) for r in pages.dataset_names(df).collect()}
    assert named == {(7, "table", "north_pier_2_soundings_off_the_pier"), (7, "table", "north_pier_2_dues"), (8, "article", "quay_example")}
    assert pages.dataset_names(df, tables_only=True).count() == 2
    assert pages.extract_tables(df, max_tables=1).select("table_index").distinct().count() == 1
    assert [tuple(r) for r in pages.extract_articles(df).filter("page_id = 8").collect()] == [(8, "Ebb and flow", "The bar dries.\n\nKeep east")]


def test_references_cut_off_before_their_semicolon(spark, tmp_path):
    """A title cut inside a reference keeps what is written, as the query's SQL has it; a page that is null has no title."""
    cut = "<html><head><title>x</title></head><body><h1>Eel &amp;&amp; ray&amp;&amp</h1><p>a&lt;b &ampc &amplt; &notit; &eacute; R&D &</p></body></html>"
    whole = "<h1>Q&quot;&#x27;&gt;</h1>"
    spark.createDataFrame([(1, cut), (2, None), (3, whole)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert pages.extract_articles(spark.read.parquet(str(tmp_path / "pages.parquet"))).filter("page_id = 1").first()["text"] == "a<b &ampc &amplt; &notit; é R&D &"
    got = queries.QUERIES["s12_articles"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "Eel && ray&&amp", True), (2, None, None), (3, "Q\"'>", False)]
    sql = queries.ORACLE_SQL["s12_articles"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet') ORDER BY page_id")
    assert duckdb.sql(sql).fetchall() == [tuple(r) for r in got]


def test_files_catalog_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, 'q"u,o'), (3, None)], "k int, v string")
    report = files.write_file(df, str(tmp_path / "x.csv"), "csv")
    assert report.dry_run and report.skipped == 3 and not (tmp_path / "x.csv").exists()
    assert files.write_file(df, str(tmp_path / "x.csv"), "csv", dry_run=False).written == 3
    cat = files.Catalog(spark)
    cat.open_file(str(tmp_path / "x.csv"))
    assert cat.describe("x") == [("k", "int"), ("v", "string")] and cat.count_rows("x") == 3
    assert cat.open_file(str(tmp_path / "x.csv")).name == "x_2"
    assert [r["k"] for r in cat.page("x", ["k"], 1, 1).collect()] == [2]
    assert cat.derive("x", ["V"], "d").df.columns == ["v"] and spark.table("d").count() == 3
    with pytest.raises(ValueError, match="a, b"):
        cat.derive("x", ["a", "b"], "e")
    for bad in (lambda: files.read_file(spark, "x.xlsx"), lambda: cat.get("none"), lambda: files.write_table(df, "a b"), lambda: files.page(df, [], 0, 1)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "a.tsv").write_text("a\tb\n1\tx\n")
    assert files.read_file(spark, str(tmp_path / "a.json")).count() == 2 and files.read_file(spark, str(tmp_path / "a.tsv")).first()["b"] == "x"


def test_database_options_and_round_trip(spark):
    o = files.jdbc_options("postgresql", {"host": "h", "database": "d b", "user": "u", "password": "p/w"})
    assert o["url"] == "jdbc:postgresql://h:5432/d%20b" and files.redacted(o)["password"] == "***"
    assert files.redacted({"url": "jdbc:x://u:pw@h/d?password=z&k=1"})["url"] == "jdbc:x://u:***@h/d?password=***&k=1"
    with pytest.raises(ValueError, match="host, user"):
        files.jdbc_options("mysql", {"database": "d"})
    with pytest.raises(ValueError):
        files.read_database(spark, o)
    d = files.jdbc_options("derby", {"database": "memory:loom;create=true"})
    spark.range(10).withColumn("v", F.col("id") * 2).write.format("jdbc").options(**d, dbtable="t").save()
    assert files.read_database(spark, d, "t").count() == 10
    assert files.read_database(spark, d, "t", 'select * from t where "id" > 5').count() == 4
    assert files.read_database(spark, d, "t", partition=('"id"', 0, 10, 3)).rdd.getNumPartitions() == 3


def test_database_urls_of_cloud_warehouses():
    big = files.jdbc_options("bigquery", {"project": "p-1"})
    assert big["url"].endswith(":443;ProjectId=p-1;OAuthType=3") and "password" not in big
    athena = files.jdbc_options("athena", {"region": "eu-west-1", "output": "s3://b/out/", "database": "logs"})
    assert athena["url"] == "jdbc:athena://Region=eu-west-1;Database=logs;OutputLocation=s3://b/out/;CredentialsProvider=DefaultChain"
    with pytest.raises(ValueError, match="output"):
        files.jdbc_options("athena", {"region": "eu-west-1"})


def test_database_parts_are_even_on_skewed_keys(spark):
    d = files.jdbc_options("derby", {"database": "memory:parts;create=true"})
    # A third of all rows have one key, a tenth none; the others crowd at one end.
    key = F.when(F.col("id") % 3 == 0, 77).when(F.col("id") % 10 == 1, None).otherwise(F.floor(F.pow(F.col("id"), 3) / 1_000_000) - 500).cast("long")
    spark.range(6000).select(key.alias("k"), "id").write.format("jdbc").options(**d, dbtable="skewed").save()
    parts = files.database_parts(spark, d, "skewed", ['"k"', '"id"'], 8)
    read = files.read_database(spark, d, "skewed", parts=parts)
    sizes = [r["n"] for r in read.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sorted(r["id"] for r in read.collect()) == list(range(6000))
    assert 8 <= len(sizes) <= 16 and max(sizes) <= 750 and sorted(sizes)[1] * 2 >= max(sizes)
    # One column cannot cut the hot key, and rows that come later, beyond all bounds too, are in one part each.
    parts = files.database_parts(spark, d, "skewed", ['"k"'], 8)
    spark.createDataFrame([(-(10**9), -1), (10**12, -2), (None, -3), (78, -4)], "k long, id long").write.format("jdbc").options(**d, dbtable="skewed").mode("append").save()
    both = [files.read_database(spark, d, "skewed", parts=p) for p in (parts, files.database_parts(spark, d, "(select * from skewed) s", ['"k"', '"id"'], 3))]
    assert [df.count() for df in both] == [6004, 6004] and all(df.select("id").distinct().count() == 6004 for df in both)
    spark.range(0).select(F.col("id").alias("k")).write.format("jdbc").options(**d, dbtable="nothing").save()
    assert files.read_database(spark, d, "nothing", parts=files.database_parts(spark, d, "nothing", ['"k"'], 4)).count() == 0


def test_push_plans(spark):
    df = spark.createDataFrame([(f"A-{k}", "n m*~é") for k in range(10)] + [(None, "x")], "sku string, name string")
    spec = push.PushSpec("https://api/products/{sku}?n={name}", "PUT", "sku", max_rows=8)
    requests, failures, report = push.push_plan(df.filter("sku is not null"), spec, ["sku"])
    assert requests.orderBy("request").first()["url"] == "https://api/products/A-0?n=n%20m%2A~%C3%A9" and requests.count() == 8 and report.skipped == 10
    assert report.dry_run and report.written == 0 and failures.count() == 0
    _, failures, report = push.push_plan(df, push.PushSpec("https://api/{sku}", "PUT", "sku"), ["sku"])
    assert report.failed == 1 and failures.first()["message"].startswith("a value")
    _, failures, _ = push.push_plan(df, push.PushSpec("https://api/{nope}", "PUT", "sku"), ["sku"])
    assert failures.count() == 11 and "nope" in failures.first()["message"]
    requests, _, report = push.push_plan(df, push.PushSpec("https://api/", "POST", "sku", "batch", 4, post_acknowledged=True), ["sku"], only_keys=["A-1", "A-3", "A-4", "A-7", "A-9"])
    assert sorted(r["rows"] for r in requests.collect()) == [1, 4] and all(len(r["idempotency_key"]) == 64 for r in requests.collect())
    for bad in (push.PushSpec("ftp://x", "PUT", "k"), push.PushSpec("http://x/{k}", "GET", "k"), push.PushSpec("http://x", "PUT", "k"), push.PushSpec("http://x", "POST"), push.PushSpec("http://x/{k}", "PUT", "k", chunk=0)):
        with pytest.raises(ValueError):
            bad.validate()


def test_charts(spark):
    df = spark.createDataFrame([(f"g{k % 40}", float(k % 7 - 1), "s" + str(k % 10)) for k in range(400)] + [(None, 1.0, "s1"), ("g1", None, None)], "x string, y double, c string")
    bar = charts.chart(df, {"mark": "bar", "x": "x", "y": "y"})
    ys = [r["y"] for r in bar.df.collect()]
    assert len(ys) == 30 and ys == sorted(ys, reverse=True) and bar.notes == ["top 30 of 40 groups, ranked by sum of y"]
    assert charts.chart(df, {"mark": "line", "x": "x", "y": "y"}).notes == ["first 30 of 40 values of x"]
    log = charts.chart(df, {"mark": "scatter", "x": "x", "y": "y", "y_scale": "log"} | {"x": "y"})
    assert "without a positive value" in log.notes[0] and log.df.filter("y <= 0").count() == 0
    hist = charts.chart(df, {"mark": "histogram", "x": "y"})
    assert hist.df.agg(F.sum("n")).first()[0] == 401 and hist.df.count() == 20
    folded = charts.fold_series(charts.chart(df, {"mark": "bar", "x": "x", "y": "y", "color": "c", "limit": 100}).df)
    assert folded.filter("series is not null").select("series").distinct().count() == 9
    assert charts.chart(df.limit(0), {"mark": "histogram", "x": "y"}).df.count() == 0
    board = charts.Dashboard()
    assert [board.add(charts.ChartSpec(x="x", y="y", dataset="d")) for _ in range(3)] == [(0, 0), (0, 1), (1, 0)]
    assert len(board.evaluate({"d": df})) == 3
    with pytest.raises(ValueError, match="d"):
        board.evaluate({})
    assert charts.labels(charts.ChartSpec("bar", "x", "y", "c")) == ("sum of y", "sum of y by x, split by c") and charts.labels(charts.ChartSpec("line", "x", agg="count"))[0] == "rows"
    assert charts.labels(charts.ChartSpec("histogram", "x"))[1] == "Distribution of x" and charts.labels(charts.ChartSpec("box", "x", "y", title="T")) == ("y", "T")
    for bad in ({"mark": "pie", "x": "x"}, {"mark": "bar"}, {"mark": "bar", "x": "x"}, {"mark": "bar", "x": "x", "y": "y", "agg": "mode"}, {"mark": "bar", "x": "x", "y": "y", "y_scale": "cubic"}):
        with pytest.raises(ValueError):
            charts.chart(df, bad)


def test_every_query_is_registered_with_a_plan(spark):
    assert len(queries.QUERIES) > 55 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
