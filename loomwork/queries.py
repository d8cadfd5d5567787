"""Registered queries of the preparation, mapping, mining and chart operators, with their DuckDB oracles.

Doubles are rounded on both sides, as engines add them up in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import charts, mapping, model, moments, nodes, pairs, profile, regression, suggest
from loomwork.plans import flow, scan
from loomwork.scratch import materialize, scratch_path
from loomwork.sources import files, pages, push, records
from loomwork.streaming import losses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_file(spark: SparkSession, name: str) -> str:
    """A new path that ends in ``name``, whose suffix says what is in it."""
    return f"{scratch_path(spark, 'file')}/{name}"


def rounded(df: DataFrame, digits: int = 6, only: Sequence[str] | None = None) -> DataFrame:
    """Doubles at so many digits after the point, without a negative zero."""
    names = [c for c, t in df.dtypes if t == "double" and (only is None or c in only)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in names})


#: A document holds so many records at least where its group has them, and less than twice as many.
PART_ROWS = 1000


def parts_of(df: DataFrame, key: str, order: str, rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``start``: groups of ``key`` are cut, in ``order``, into parts of ``rows`` to 2 * ``rows`` - 1 rows; ``start`` counts those before the part.

    Smaller groups are one part. Ranks are taken within ranges, and totals of
    earlier ranges added, so a group that holds most rows is not one task's.
    """
    ranged = materialize(df.repartitionByRange(key, order).withColumn("range", F.spark_partition_id()), "parts")
    counts = ranged.groupBy(key, "range").agg(F.count("*").alias("n"))  # a row for each range of a group
    before = F.sum("n").over(Window.partitionBy(key).orderBy("range")) - F.col("n")
    starts = counts.select(F.col(key).alias("of"), F.col("range").alias("at"), before.alias("before"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    within = F.row_number().over(Window.partitionBy(key, "range").orderBy(order)) - 1
    held = ranged.withColumn("within", within).join(starts, F.col(key).eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    part = F.least(F.floor((F.col("before") + F.col("within")) / rows), F.greatest(F.floor(F.col("total") / rows), F.lit(1)) - 1)
    return held.select(*df.columns, (part * rows).alias("start"))


# --- flows and nodes ----------------------------------------------------------


def flagship_doc(sf_dir: str) -> dict:
    source = lambda name: {"id": name, "type": "input_file", "params": {"path": f"{sf_dir}/{name}.parquet"}}
    steps = [
        source("lineitem"), source("orders"), source("customer"), source("nation"),
        {"id": "recent", "type": "filter", "params": {"expression": "l_shipdate >= timestamp_ntz'1995-01-01'"}},
        {"id": "money", "type": "calculated", "params": {"name": "revenue", "expression": "l_extendedprice * (1 - l_discount)"}},
        {"id": "year", "type": "calculated", "params": {"name": "ship_year", "expression": "year(l_shipdate)"}},
        {"id": "with_order", "type": "join", "params": {"left_on": ["l_orderkey"], "right_on": ["o_orderkey"]}},
        {"id": "with_customer", "type": "join", "params": {"left_on": ["o_custkey"], "right_on": ["c_custkey"]}},
        {"id": "with_nation", "type": "join", "params": {"left_on": ["c_nationkey"], "right_on": ["n_nationkey"]}},
        {"id": "sums", "type": "aggregate", "params": {"group_by": ["n_name", "ship_year", "l_returnflag"], "aggregations": ["sum(revenue) AS revenue"]}},
        {"id": "wide", "type": "pivot", "params": {"on": "l_returnflag", "using": ["round(sum(revenue), 2)"], "group_by": ["n_name", "ship_year"], "values": ["A", "N", "R"]}},
    ]
    edges = [("lineitem", "recent", 0), ("recent", "money", 0), ("money", "year", 0), ("year", "with_order", 0), ("orders", "with_order", 1), ("with_order", "with_customer", 0), ("customer", "with_customer", 1), ("with_customer", "with_nation", 0), ("nation", "with_nation", 1), ("with_nation", "sums", 0), ("sums", "wide", 0)]
    return {"schema": 1, "nodes": steps, "edges": [{"src": a, "dst": b, "port": k} for a, b, k in edges]}


@query(
    """SELECT n_name, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
      round(sum(r) FILTER (l_returnflag = 'A'), 2) AS A, round(sum(r) FILTER (l_returnflag = 'N'), 2) AS N, round(sum(r) FILTER (l_returnflag = 'R'), 2) AS R
    FROM (SELECT *, l_extendedprice * (1 - l_discount) AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01') JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL"""
)
def flow_flagship(spark, sf_dir):
    return flow.run_flow(spark, flagship_doc(sf_dir), "wide")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS status, o_totalprice FROM orders")
def n1_select(spark, sf_dir):
    return nodes.select(table(spark, sf_dir, "orders"), keep=["o_orderkey", "o_orderstatus", "o_totalprice"], cast={"o_orderkey": "string"}, rename={"o_orderkey": "order_id", "o_orderstatus": "status"})


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 150000 AND nullif(o_orderstatus, 'P') <> 'F'")
def n2_filter(spark, sf_dir):
    return nodes.filter_rows(table(spark, sf_dir, "orders"), "o_totalprice > 150000 AND nullif(o_orderstatus, 'P') <> 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem")
def n3_calculated(spark, sf_dir):
    return nodes.calculated(table(spark, sf_dir, "lineitem"), "unit_price", "l_extendedprice / nullif(l_quantity, 0)").select("l_orderkey", "l_linenumber", "unit_price")


CUSTOMER_ORDERS = "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey"


def customer_orders(spark, sf_dir):
    return nodes.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), ["c_custkey"], ["o_custkey"], "left").select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice", "o_orderstatus")


@query(f"SELECT * FROM ({CUSTOMER_ORDERS}) WHERE o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL")
def n4_drop_nulls(spark, sf_dir):
    return nodes.clean_nulls(customer_orders(spark, sf_dir), "drop", ["o_orderkey", "o_orderstatus"])


@query(f"SELECT c_custkey, c_mktsegment, o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, o_orderstatus FROM ({CUSTOMER_ORDERS})")
def n5_fill_nulls(spark, sf_dir):
    return nodes.clean_nulls(customer_orders(spark, sf_dir), "fill", ["o_totalprice"], "0")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL")
def n6_aggregate(spark, sf_dir):
    return nodes.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["round(sum(l_quantity), 2) AS sum_qty", "round(avg(l_extendedprice), 4) AS avg_price", "count(*) AS n", "count(DISTINCT l_orderkey) AS n_orders"])


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT l_shipdate) AS days FROM lineitem")
def n6_aggregate_whole(spark, sf_dir):
    return nodes.aggregate(table(spark, sf_dir, "lineitem").withColumn("o_totalprice", F.col("l_extendedprice")), [], ["count(*) AS n", "round(sum(o_totalprice), 2) AS total", "count(DISTINCT l_shipdate) AS days"])


ORACLE_SQL["n6_aggregate_whole"] = "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, count(DISTINCT l_shipdate) AS days FROM lineitem"


@query("SELECT c_custkey AS custkey, o_orderkey, c_name FROM orders FULL JOIN customer ON o_custkey = c_custkey AND o_custkey % 3 <> 0 WHERE c_custkey IS NOT NULL UNION ALL SELECT o_custkey, o_orderkey, NULL FROM orders WHERE o_custkey % 3 = 0")
def n7_join_using(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("custkey", F.expr("if(o_custkey % 3 = 0, null, o_custkey)"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "CUSTKEY")
    found = nodes.join(orders, customers, ["custkey"], how="full")
    return found.select(F.coalesce("custkey", F.when(F.col("c_name").isNull(), F.col("o_custkey"))).alias("custkey"), "o_orderkey", "c_name")


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def n8_join_on(spark, sf_dir):
    return nodes.join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), ["n_regionkey"], ["r_regionkey"])


@query("SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nk, c_custkey AS k_1, c_name AS name_1 FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def n8b_join_clash(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("ck"))
    return nodes.join(a, b, ["nk", "k"], ["ck", "k"]).drop("ck")


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier")
def n9_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS extra")
    return nodes.union(a, table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS id", "s_name AS name"))


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F_total, count(*) FILTER (o_orderstatus = 'F') AS F_n, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O_total, count(*) FILTER (o_orderstatus = 'O') AS O_n FROM orders GROUP BY 1")
def n10_pivot(spark, sf_dir):
    wide = nodes.pivot(table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), "o_orderstatus", ["round(sum(o_totalprice), 2) AS total", "count(1) AS n"], ["o_orderpriority"])
    return wide.fillna(0, ["F_n", "O_n"])


@query("SELECT o_orderpriority, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS position, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, NULL, NULL, NULL, NULL FROM orders GROUP BY 1 HAVING count(o_custkey) = 0")
def n10_pivot_cells(spark, sf_dir):
    """A pivot with a column for each customer, in long form: their number grows with the table."""
    return nodes.pivot_cells(table(spark, sf_dir, "orders"), "o_custkey", ["round(sum(o_totalprice), 2) AS total", "count(1) AS n"], ["o_orderpriority"])


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, 'p_size' AS name, CAST(nullif(p_size, 7) AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part) WHERE value IS NOT NULL")
def n11_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).cast("double").alias("p_size"), "p_retailprice")
    return nodes.unpivot(wide, ["p_size", "p_retailprice"])


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice < a - 0.4 * (b - a) OR l_extendedprice > b + 0.4 * (b - a) AS is_outlier FROM lineitem, q")
def n12_outliers_iqr(spark, sf_dir):
    return nodes.outliers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "iqr", 0.4)


@query("WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT event_id, value FROM events, s WHERE NOT coalesce(abs(value - m) > 1.5 * d, false)")
def n13_outliers_zscore(spark, sf_dir):
    return nodes.outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", "zscore", 1.5, "remove")


@query("SELECT least(count(*), 5000) AS n FROM lineitem")
def n14_sample(spark, sf_dir):
    return nodes.sample(table(spark, sf_dir, "lineitem"), 5000, seed=7).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY left(md5('7:' || l_orderkey || ':' || l_linenumber), 15) LIMIT 20000")
def n14_large_sample(spark, sf_dir):
    """More rows than a task's best are merged for; which rows they are depends on their keys only."""
    return nodes.sample(table(spark, sf_dir, "lineitem"), 20_000, 7, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


# --- mapping ------------------------------------------------------------------

PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}


def steps(*each) -> list[dict]:
    return [{"key": e[0], "args": e[1] if len(e) > 1 else {}} for e in each]


def transform_doc() -> dict:
    def f(target, *each, source="p_name"):
        return {"target": target, "sources": [source], "steps": steps(*each)}

    return {"fields": [
        {"target": "p_partkey", "sources": ["p_partkey"]},
        f("trimmed", ("prepend", {"text": "  "}), ("trim",)), f("upper", ("upper",)), f("lower", ("lower",), source="p_brand"), f("title", ("title",)),
        f("short", ("truncate", {"length": 4})), f("pre", ("prepend", {"text": "<"}), ("append", {"text": ">"})), f("swapped", ("replace", {"find": "a", "with": "[a]"})),
        f("part2", ("split_part", {"sep": " ", "index": 2}), source="p_type"), f("digits", ("regex_extract", {"pattern": r"#(\d+)", "group": 1}), source="p_brand"),
        f("masked", ("regex_replace", {"pattern": r"([A-Z])(\d)", "with": r"\2$\1"}), source="p_brand"), f("padded", ("pad", {"length": 12, "char": "*"}), source="p_brand"),
        f("right", ("pad", {"length": 5, "char": "_", "side": "right"}), source="p_brand"), f("rounded", ("round", {"places": 1}), source="p_retailprice"),
        f("filled", ("expression", {"sql": "nullif({value}, 7)"}), ("default", {"value": "-1"}), source="p_size"), f("whole", ("cast", {"type": "BIGINT"}), source="p_retailprice"),
        f("sized", ("cast", {"type": "VARCHAR"}), ("append", {"text": ".5"}), ("cast", {"type": "BIGINT"}), source="p_size"),
        {"target": "joined", "sources": ["p_brand", "p_size"], "join_with": "/"}, {"target": "fixed", "constant": "x"},
        {"target": "money", "sources": ["p_retailprice"], "type": "DECIMAL(10,2)"},
    ]}


@query(
    r"""SELECT p_partkey, trim('  ' || p_name) AS trimmed, upper(p_name) AS upper, lower(p_brand) AS lower,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title, substr(p_name, 1, 4) AS short, '<' || p_name || '>' AS pre,
      replace(p_name, 'a', '[a]') AS swapped, split_part(p_type, ' ', 2) AS part2, regexp_extract(p_brand, '#(\d+)', 1) AS digits, regexp_replace(p_brand, '([A-Z])(\d)', '\2$\1', 'g') AS masked,
      lpad(p_brand, 12, '*') AS padded, rpad(p_brand, 5, '_') AS right, round(p_retailprice, 1) AS rounded, coalesce(nullif(p_size, 7), -1) AS filled, CAST(round_even(p_retailprice, 0) AS BIGINT) AS whole,
      CAST(p_size + 1 AS BIGINT) AS sized, p_brand || '/' || p_size AS joined, 'x' AS fixed, CAST(p_retailprice AS DECIMAL(10,2)) AS money FROM part"""
)
def t_transforms(spark, sf_dir):
    return mapping.apply_mapping(table(spark, sf_dir, "part"), mapping.MappingDoc.from_dict(transform_doc()))


DATE_DOC = {"fields": [
    {"target": "o_orderkey", "sources": ["o_orderkey"]},
    {"target": "text", "sources": ["o_orderdate"], "steps": steps(("date_format", {"format": "%d/%m/%Y %H:%M"}))},
    {"target": "back", "sources": ["o_orderdate"], "steps": steps(("date_format", {"format": "%Y-%m-%d"}), ("parse_date", {"format": "%Y-%m-%d"}))},
    {"target": "day", "sources": ["o_orderdate"], "steps": steps(("date_format", {"format": "on %j, %y"}))},
    {"target": "d", "sources": ["o_orderdate"], "type": "DATE"},
    {"target": "bad", "sources": ["o_orderpriority"], "steps": steps(("parse_date", {"format": "%Y-%m-%d"}))},
]}


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS text, date_trunc('day', o_orderdate)::TIMESTAMP AS back, strftime(o_orderdate, 'on %j, %y') AS day, o_orderdate::DATE AS d, NULL::TIMESTAMP AS bad FROM orders")
def t_dates(spark, sf_dir):
    return mapping.apply_mapping(table(spark, sf_dir, "orders"), mapping.MappingDoc.from_dict(DATE_DOC))


@query("SELECT o_orderstatus, o_orderdate, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE o_orderpriority END AS priority, CAST(o_totalprice AS DECIMAL(18,4)) AS price FROM orders")
def m3_passthrough(spark, sf_dir):
    fields = [{"target": "id", "sources": ["O_ORDERKEY"]}, {"target": "priority", "sources": ["o_orderpriority"], "steps": steps(("lookup", {"pairs": list(PRIORITIES.items())}))}, {"target": "price", "sources": ["o_totalprice"], "steps": steps(("cast", {"type": "DECIMAL(18,4)"}))}]
    return mapping.apply_mapping(table(spark, sf_dir, "orders"), mapping.MappingDoc.from_dict({"fields": fields, "unmapped": "passthrough"})).drop("o_custkey")


@query("SELECT c_name || ' ' || c_mktsegment AS label, CAST(NULL AS DOUBLE) AS spare, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer")
def m3_null_policy(spark, sf_dir):
    doc = {"fields": [{"target": "balance", "sources": ["c_acctbal"]}, {"target": "LABEL", "sources": ["c_name", "c_mktsegment"]}], "unmapped": "null", "schema": [{"name": "label", "type": "VARCHAR", "required": True}, {"name": "spare", "type": "DOUBLE"}, {"name": "balance", "type": "DECIMAL(18,2)"}]}
    return mapping.apply_mapping(table(spark, sf_dir, "customer"), mapping.MappingDoc.from_dict(doc)).withColumnRenamed("LABEL", "label")


LOSS_DOC = {"fields": [
    {"target": "size", "sources": ["p_type"], "type": "INTEGER"},
    {"target": "day", "sources": ["p_brand"], "steps": steps(("parse_date", {"format": "%Y"}))},
    {"target": "n", "sources": ["p_name"], "steps": steps(("cast", {"type": "DOUBLE"}), ("default", {"value": "0"}), ("cast", {"type": "BIGINT"}))},
    {"target": "brand", "sources": ["p_brand"], "steps": steps(("lookup", {"pairs": [["Brand#11", "one"], ["Brand#12", "two"]]}))},
    {"target": "both", "sources": ["p_type", "p_size"], "join_with": "", "type": "DATE"},
]}


@query("SELECT count(p_type) AS size__lost, count(p_brand) AS day__lost_parse_date, count(p_name) AS n__lost_cast, 0 AS n__lost_cast_2, count(*) FILTER (p_brand NOT IN ('Brand#11', 'Brand#12')) AS brand__unmatched, count(*) AS both__lost FROM part")
def m5_loss_counters(spark, sf_dir):
    return mapping.loss_counters(table(spark, sf_dir, "part"), mapping.MappingDoc.from_dict(LOSS_DOC))


@query("WITH x AS (SELECT CAST(o_custkey AS VARCHAR) AS k, min(o_orderpriority) AS v FROM orders GROUP BY 1) SELECT c_custkey, coalesce(v, CAST(c_custkey AS VARCHAR)) AS priority FROM customer LEFT JOIN x ON k = CAST(c_custkey AS VARCHAR)")
def m6_crosswalk(spark, sf_dir):
    doc = {"fields": [{"target": "c_custkey", "sources": ["c_custkey"]}, {"target": "priority", "sources": ["c_custkey"], "steps": steps(("lookup", {"file": "orders"}))}]}
    return mapping.apply_mapping(table(spark, sf_dir, "customer"), mapping.MappingDoc.from_dict(doc), {"orders": table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")})


@query("""WITH v AS (SELECT DISTINCT 'c_nationkey' AS source, CAST(c_nationkey AS VARCHAR) AS x FROM customer UNION SELECT DISTINCT 'c_mktsegment', lower(trim(c_mktsegment)) FROM customer),
  w AS (SELECT DISTINCT 'n_nationkey' AS target, CAST(n_nationkey AS VARCHAR) AS x FROM nation UNION SELECT DISTINCT 'n_name', lower(trim(n_name)) FROM nation UNION SELECT DISTINCT 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation)
  SELECT source, target, count(*) AS shared, round(count(*) / least(any_value(a), any_value(b)), 6) AS confidence FROM v JOIN w USING (x) JOIN (SELECT source, count(*) AS a FROM v GROUP BY 1) USING (source) JOIN (SELECT target, count(*) AS b FROM w GROUP BY 1) USING (target) GROUP BY 1, 2""")
def m10_suggest_values(spark, sf_dir):
    return rounded(suggest.suggest_by_values(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), ["c_nationkey", "c_mktsegment"]))


#: The names in the tables as two catalogs of columns, and SequenceMatcher's blocks: the longest common run, the first of equal ones, then what is left and right of it.
M9_SQL = """WITH RECURSIVE s AS (SELECT DISTINCT c_name AS source FROM customer WHERE c_name IS NOT NULL UNION SELECT p_name FROM part WHERE p_name IS NOT NULL),
  t AS (SELECT DISTINCT s_name AS target, 1e0 AS types FROM supplier WHERE s_name IS NOT NULL UNION SELECT p_brand, 1e0 FROM part WHERE p_brand IS NOT NULL UNION SELECT n_name, 0.5e0 FROM nation WHERE n_name IS NOT NULL),
  sw AS (SELECT *, list_distinct(list_transform(regexp_extract_all(source, '[A-Z]*[a-z0-9]+|[A-Z]+'), lambda w: lower(w))) AS w, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS a FROM s),
  tw AS (SELECT *, list_distinct(list_transform(regexp_extract_all(target, '[A-Z]*[a-z0-9]+|[A-Z]+'), lambda w: lower(w))) AS v, regexp_replace(lower(target), '[^a-z0-9]', '', 'g') AS b FROM t),
  overlap AS (SELECT source, target, types, a, b, list_sort(list_intersect(w, v)) AS shared, len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v)))::DOUBLE AS jaccard FROM sw, tw),
  pairs AS (SELECT * FROM overlap WHERE 0.5e0 * jaccard + 0.3e0 * 2 * least(len(a), len(b)) / (len(a) + len(b)) + 0.2e0 * types > 0.449999 AND (jaccard > 0 OR (abs(len(a) - len(b)) <= (len(a) + len(b)) / 6e0 AND types = 1
    AND 2 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda x: least(len(a) - len(replace(a, x, '')), len(b) - len(replace(b, x, ''))))) >= 0.8333 * (len(a) + len(b))))),
  letters AS (SELECT source, target, i, j FROM pairs, unnest(range(1, len(a) + 1)) x(i), unnest(range(1, len(b) + 1)) y(j) WHERE a[i] = b[j]),
  islands AS (SELECT *, i - row_number() OVER (PARTITION BY source, target, i - j ORDER BY i) AS island FROM letters),
  runs AS (SELECT source, target, i, j, max(i) OVER (PARTITION BY source, target, i - j, island) - i + 1 AS k FROM islands),
  blocks AS (SELECT source, target, CAST(1 AS BIGINT) AS al, CAST(len(a) AS BIGINT) AS ah, CAST(1 AS BIGINT) AS bl, CAST(len(b) AS BIGINT) AS bh, CAST(0 AS BIGINT) AS m FROM pairs
    UNION ALL SELECT source, target, CASE side WHEN 0 THEN al ELSE best.i + best.k END, CASE side WHEN 0 THEN best.i - 1 ELSE ah END, CASE side WHEN 0 THEN bl ELSE best.j + best.k END, CASE side WHEN 0 THEN best.j - 1 ELSE bh END, CASE side WHEN 0 THEN best.k ELSE 0 END
    FROM (SELECT source, target, al, ah, bl, bh, arg_max({'i': i, 'j': j, 'k': least(k, ah - i + 1, bh - j + 1)}, [least(k, ah - i + 1, bh - j + 1), -i, -j]) AS best FROM blocks JOIN runs USING (source, target) WHERE i BETWEEN al AND ah AND j BETWEEN bl AND bh GROUP BY ALL), unnest([0, 1]) z(side)),
  scored AS (SELECT source, target, 0.5e0 * any_value(jaccard) + 0.3e0 * (2e0 * sum(m) / any_value(len(a) + len(b))) + 0.2e0 * any_value(types) AS confidence, any_value(shared) AS shared FROM blocks JOIN pairs USING (source, target) GROUP BY ALL)
  SELECT source, target, round(confidence, 6) AS confidence, array_to_string(shared, ',') AS shared FROM scored WHERE confidence >= 0.45 QUALIFY row_number() OVER (PARTITION BY target ORDER BY confidence DESC, source) = 1"""


@query(M9_SQL)
def m9_suggest_names(spark, sf_dir):
    """Names of customers and parts for those of suppliers, brands and nations."""
    names = lambda t, c, kind: table(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(kind).alias("type"))
    sources = names("customer", "c_name", "string").unionAll(names("part", "p_name", "varchar"))
    targets = names("supplier", "s_name", "string").unionAll(names("part", "p_brand", "char(10)")).unionAll(names("nation", "n_name", "binary"))
    return rounded(suggest.suggest_by_name(sources, targets).withColumn("shared", F.array_join("shared", ",")))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s4_database_parts(spark, sf_dir):
    """Orders written to an embedded database and read back in parts of like size. The database lives in one JVM, so this runs in local sessions only."""
    options = files.jdbc_options("derby", {"database": f"memory:loom{uuid.uuid4().hex};create=true"})
    table(spark, sf_dir, "orders").coalesce(4).write.format("jdbc").options(**options, dbtable="orders").save()
    parts = files.database_parts(spark, options, "orders", ['"o_custkey"', '"o_orderkey"'], 8)
    return files.read_database(spark, options, "orders", parts=parts).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


# --- profile --------------------------------------------------------------------


@query("""SELECT 'value' AS "column", 'double' AS type, count(*) AS rows, count(*) - count(value) AS nulls, count(DISTINCT value) AS distinct FROM events UNION ALL SELECT 'event_type', 'string', count(*), count(*) - count(nullif(event_type, 'view')), count(DISTINCT nullif(event_type, 'view')) FROM events UNION ALL SELECT 'user_id', 'bigint', count(*), 0, count(DISTINCT user_id) FROM events""")
def p1_column_counts(spark, sf_dir):
    return profile.column_counts(table(spark, sf_dir, "events").select("value", F.nullif("event_type", F.lit("view")).alias("event_type"), "user_id"), exact=True)


@query("""SELECT * FROM (SELECT 'o_totalprice' AS "column", round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4) FROM orders)""")
def p2_numeric_summary(spark, sf_dir):
    return rounded(profile.numeric_summary(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]), 4)


HISTOGRAM = """b_{c} AS (SELECT min({c}) AS a, (max({c}) - min({c})) / 10 AS w FROM {t}), h_{c} AS (SELECT '{c}' AS "column", i AS bin, (SELECT count(*) FROM {t}, b_{c} WHERE least(floor(({c} - a) / w), 9) = i) AS n FROM range(10) r(i))"""


@query(f"WITH {HISTOGRAM.format(c='l_quantity', t='lineitem')}, {HISTOGRAM.format(c='l_extendedprice', t='lineitem')} SELECT \"column\", CAST(bin AS INTEGER) AS bin, n FROM (FROM h_l_quantity UNION ALL FROM h_l_extendedprice)")
def p2_histograms(spark, sf_dir):
    return profile.histograms(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]).select("column", "bin", "n")


@query("""SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)) WHERE k <= 8""")
def p3_top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT count(*) AS rows, count(*) - count(value) AS nulls, count(DISTINCT value) AS distinct, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, round(median(value), 6) AS median FROM events")
def p4_column_stats(spark, sf_dir):
    return rounded(profile.column_stats(table(spark, sf_dir, "events"), "value"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count_rows, round(avg(o_totalprice), 4) AS avg_o_totalprice, round(median(o_totalprice), 4) AS median_o_totalprice, round(stddev_samp(o_totalprice), 4) AS stddev_o_totalprice FROM orders GROUP BY 1, 2 HAVING count(*) >= 5")
def p5_governed_aggregate(spark, sf_dir):
    return rounded(profile.governed_aggregate(table(spark, sf_dir, "orders"), [("count", "*"), ("avg", "o_totalprice"), ("median", "o_totalprice"), ("stddev", "o_totalprice")], ["o_orderstatus", "o_orderpriority"], min_group_size=5), 4)


@query("SELECT count(*) AS rows, count(*) - count(o_orderpriority) AS nulls, count(DISTINCT o_orderpriority) AS distinct FROM orders")
def p4_text_column_stats(spark, sf_dir):
    return profile.column_stats(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT CAST(least(200, count(DISTINCT l_partkey)) AS INTEGER) AS n FROM lineitem")
def p6_capped(spark, sf_dir):
    return profile.capped(table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))).agg(F.count("*").cast("int").alias("n"))


@query("""WITH s AS (SELECT count(DISTINCT o_orderpriority) AS levels FROM orders) SELECT * FROM (VALUES (0, 'o_orderkey', 'numeric'), (1, 'o_custkey', 'numeric'), (2, 'o_orderstatus', 'categorical'), (3, 'o_totalprice', 'numeric'), (4, 'o_orderdate', 'excluded'), (5, 'o_orderpriority', 'categorical'), (6, 'none', 'excluded'), (7, 'same', 'excluded'), (8, 'ident', 'excluded'), (9, 'flag', 'numeric')) t(position, "column", role)""")
def p7_classify(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns({"none": F.lit(None).cast("string"), "same": F.lit(1), "ident": F.concat(F.lit("k"), F.col("o_orderkey")), "flag": F.col("o_totalprice") > 100000})
    return profile.classify(orders).select("position", "column", "role")


# --- tests and models -------------------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def simpson(log_density: str, start: str, stop: str, steps: int = 4000) -> str:
    """DuckDB: the integral of exp(log_density in x) from ``start`` to ``stop``."""
    h = f"(({stop}) - ({start})) / {steps}"
    return f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp({log_density.replace('{x}', f'(({start}) + i * {h})')}))) * {h} / 3"


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    """DuckDB: the tail of the F distribution, as an integral over the angle whose squared tangent is f * d1 / d2."""
    start = f"atan(sqrt(({f}) * ({d1}) / ({d2})::DOUBLE))"
    density = f"(({d1}) - 1) * ln(greatest(sin({{x}}), 1e-300)) + (({d2}) - 1) * ln(greatest(cos({{x}}), 1e-300)) + lgamma((({d1}) + ({d2})) / 2.0::DOUBLE) - lgamma(({d1}) / 2.0::DOUBLE) - lgamma(({d2}) / 2.0::DOUBLE) + ln(2)"
    return simpson(density, start, f"least(pi() / 2, {start} + 40 / sqrt({d2}))")


def t_tail_sql(r: str, n: str) -> str:
    """DuckDB: the two-sided tail of a correlation."""
    return f_tail_sql(f"({r}) * ({r}) * (({n}) - 2) / (1 - ({r}) * ({r}))", "1", f"(({n}) - 2)")


def chi2_tail_sql(chi2: str, df: str) -> str:
    """DuckDB: the tail of the chi-square distribution, as an integral over its root."""
    density = f"(({df}) - 1) * ln(greatest({{x}}, 1e-300)) - {{x}} * {{x}} / 2 + (1 - ({df}) / 2.0::DOUBLE) * ln(2) - lgamma(({df}) / 2.0::DOUBLE)"
    return simpson(density, f"sqrt({chi2})", f"sqrt({chi2}) + 14")


PEARSON_SQL = "SELECT *, round({p}, 8) AS p_value FROM (SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem)".replace("{p}", t_tail_sql("r", "n"))


@query(f"SELECT a, b, round(r, 6) AS statistic, p_value, round(abs(r), 6) AS effect, n FROM ({' UNION ALL '.join(PEARSON_SQL.replace('{a}', a).replace('{b}', b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])})")
def p8_pearson(spark, sf_dir):
    found = pairs.tests_frame(spark, pairs.pearson_tests(table(spark, sf_dir, "lineitem"), NUMBERS, rank=False)).select("a", "b", "statistic", "p_value", "effect", "n")
    return rounded(rounded(found, 8, ["p_value"]), 6, ["statistic", "effect"])


#: Columns with different values missing, so that a column's ranks differ by the pair it is in.
GAPS = {"quantity": "if(l_linenumber = 3, null, l_quantity)", "price": "l_extendedprice", "discount": "if(l_quantity > 40, null, l_discount)", "tax": "if(l_linenumber = 3, null, l_tax)"}
RANKED_SQL = """SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(f"WITH g AS (SELECT {', '.join(f'{v} AS {k}' for k, v in GAPS.items())} FROM lineitem) ".replace("if(", "IF(") + " UNION ALL ".join(RANKED_SQL.replace("{a}", a).replace("{b}", b) for i, a in enumerate(GAPS) for b in list(GAPS)[i + 1 :]))
def p9_all_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*[F.expr(v).alias(k) for k, v in GAPS.items()])
    return rounded(pairs.tests_frame(spark, pairs.pearson_tests(lines, list(GAPS))).select("a", "b", "n", "rho"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r")
def p9_spearman(spark, sf_dir):
    return rounded(pairs.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice"))


ANOVA_SQL = """SELECT '{a}' AS a, '{b}' AS b, f, {p} AS p, eta, n FROM (SELECT sum(n * (m - grand)^2) / (count(*) - 1) / (sum(m2) / (sum(n) - count(*))) AS f, count(*) - 1 AS d1, sum(n) - count(*) AS d2, sum(n * (m - grand)^2) / (sum(n * (m - grand)^2) + sum(m2)) AS eta, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand FROM (SELECT {b} AS l, count(*) AS n, avg({a}) AS m, var_pop({a}) * count(*) AS m2 FROM {t} GROUP BY 1 HAVING count(*) >= 3)))""".replace("{p}", f_tail_sql("f", "d1", "d2"))
CHI_SQL = """SELECT '{a}' AS a, '{b}' AS b, chi2, {p} AS p, sqrt(chi2 / (n * (least(ra, rb) - 1))) AS v, n FROM (SELECT sum((abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END)^2 / e) AS chi2, any_value(dof) AS dof, any_value(ra) AS ra, any_value(rb) AS rb, CAST(any_value(total) AS BIGINT) AS n
  FROM (SELECT *, (ra - 1) * (rb - 1) AS dof FROM (SELECT r.a, k.b, coalesce(c.n, 0) AS o, na * nb / total AS e, total, count(DISTINCT r.a) OVER () AS ra, count(DISTINCT k.b) OVER () AS rb
  FROM (SELECT {a} AS a, count(*) AS na FROM {t} GROUP BY 1) r CROSS JOIN (SELECT {b} AS b, count(*) AS nb FROM {t} GROUP BY 1) k CROSS JOIN (SELECT count(*) AS total FROM {t}) t
  LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY ALL) c ON c.a = r.a AND c.b = k.b)))""".replace("{p}", chi2_tail_sql("chi2", "dof"))


def filled(sql: str, **names: str) -> str:
    for k, v in names.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


@query(f"SELECT a, b, round(f, 6) AS statistic, round(p, 8) AS p_value, round(eta, 8) AS effect, n FROM ({filled(ANOVA_SQL, a='o_totalprice', b='o_orderpriority', t='orders')} UNION ALL {filled(ANOVA_SQL, a='o_totalprice', b='o_custkey', t='orders')})")
def p10_anova(spark, sf_dir):
    """Five levels, and as many as there are customers."""
    found = pairs.tests_frame(spark, pairs.anova_tests(table(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderpriority", "o_custkey"]))
    return rounded(rounded(found.select("a", "b", "statistic", "p_value", "effect", "n"), 6, ["statistic"]), 8, ["effect", "p_value"])


CHI_SHOWN = "SELECT a, b, round(chi2, 6) AS statistic, round(p, 8) AS p_value, round(v, 6) AS effect FROM"


@query(f"{CHI_SHOWN} ({filled(CHI_SQL, a='o_orderstatus', b='o_orderpriority', t='orders')})")
def p11_chi_square(spark, sf_dir):
    found = pairs.tests_frame(spark, pairs.chi_square_tests(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])).select("a", "b", "statistic", "p_value", "effect")
    return rounded(rounded(found, 8, ["p_value"]), 6, ["statistic", "effect"])


@query(f"WITH t AS (SELECT l_tax > 0.04 AS taxed, l_quantity > 45 AS large, l_suppkey FROM lineitem) {CHI_SHOWN} ({' UNION ALL '.join(filled(CHI_SQL, a=a, b=b, t='t') for a, b in (('taxed', 'large'), ('taxed', 'l_suppkey'), ('large', 'l_suppkey')))})")
def p11_yates_and_many_levels(spark, sf_dir):
    """Two columns of two levels, so with Yates's correction, and each with all suppliers."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_tax") > 0.04).alias("taxed"), (F.col("l_quantity") > 45).alias("large"), "l_suppkey")
    found = pairs.tests_frame(spark, pairs.chi_square_tests(lines, ["taxed", "large", "l_suppkey"])).select("a", "b", "statistic", "p_value", "effect")
    return rounded(rounded(found, 8, ["p_value"]), 6, ["statistic", "effect"])


LEVELS = ["l_returnflag", "l_linestatus", "l_linenumber"]
ALL_SQL = (
    [f"SELECT a, b, 'num-num' AS kind, 'pearson' AS test, r AS statistic, p_value, abs(r) AS effect, n FROM ({filled(PEARSON_SQL, a=a, b=b)})" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
    + [f"SELECT a, b, 'num-cat', 'anova', f, p, eta, n FROM ({filled(ANOVA_SQL, a=a, b=b, t='lineitem')})" for a in NUMBERS for b in LEVELS]
    + [f"SELECT a, b, 'cat-cat', 'chi-square', chi2, p, v, n FROM ({filled(CHI_SQL, a=a, b=b, t='lineitem')})" for i, a in enumerate(LEVELS) for b in LEVELS[i + 1 :]]
)


@query(f"SELECT a, b, kind, test, round(statistic, 5) AS statistic, round(p_value, 8) AS p_value, round(effect, 5) AS effect, n FROM ({' UNION ALL '.join(ALL_SQL)})")
def p12_all_pairs(spark, sf_dir):
    found = pairs.tests_frame(spark, pairs.all_pairs(table(spark, sf_dir, "lineitem"), NUMBERS, LEVELS)).select("a", "b", "kind", "test", "statistic", "p_value", "effect", "n")
    return rounded(rounded(found, 8, ["p_value"]), 5, ["statistic", "effect"])


@query("""WITH t AS (SELECT p_partkey, p_retailprice / 2100.0 AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, count(*) OVER () AS n FROM t)
  SELECT p_partkey, round(least(1, min(p * n / k) OVER (ORDER BY k DESC)), 8) AS q_value FROM r""")
def p13_false_discovery(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 2100.0).alias("p_value"))
    return rounded(pairs.with_q_values(tests).select("p_partkey", "q_value"), 8)


@query("""WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r, regr_slope(y, ln(x)) AS lb, regr_intercept(y, ln(x)) AS la, regr_r2(y, ln(x)) AS lr,
    regr_slope(ln(y), x) AS eb, regr_intercept(ln(y), x) AS ea, regr_r2(ln(y), x) AS er, regr_slope(ln(y), ln(x)) AS pb, regr_intercept(ln(y), ln(x)) AS pa, regr_r2(ln(y), ln(x)) AS pr, avg(y) AS my FROM d),
  e AS (SELECT 1 - sum((exp(ea + eb * x) - y)^2) / sum((y - my)^2) AS er2, 1 - sum((exp(pa + pb * ln(x)) - y)^2) / sum((y - my)^2) AS pr2 FROM d, s)
  SELECT form, CAST(n AS BIGINT) AS n, round(native, 6) AS native_r2, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, round(a, 4) AS intercept, round(b, 6) AS slope
  FROM (SELECT 'linear' AS form, n, r AS native, r AS r2, a, b FROM s UNION ALL SELECT 'log-x', n, lr, lr, la, lb FROM s UNION ALL SELECT 'log-y', n, er, er2, ea, eb FROM s, e UNION ALL SELECT 'log-log', n, pr, pr2, pa, pb FROM s, e)""")
def p14_ladder(spark, sf_dir):
    fits = [f for f in regression.ladder(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"]) if f.form != "quadratic"]
    found = regression.fits_frame(spark, fits).select("form", "n", "native_r2", "r2", "adj_r2", "intercept", "slope")
    return rounded(rounded(found, 4, ["intercept"]), 6, ["native_r2", "r2", "adj_r2", "slope"])


@query("""WITH z AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS d FROM lineitem), v AS (SELECT (l_quantity - m) / d AS z, l_extendedprice AS y FROM lineitem, z),
  s AS (SELECT covar_pop(z, z) AS a, covar_pop(z, z*z) AS b, covar_pop(z*z, z*z) AS c, covar_pop(z, y) AS p, covar_pop(z*z, y) AS q, var_pop(y) AS v FROM v)
  SELECT 'quadratic' AS form, round(((p * c - q * b) / (a * c - b * b) * p + (a * q - b * p) / (a * c - b * b) * q) / v, 6) AS r2 FROM s""")
def p14_quadratic(spark, sf_dir):
    fits = [f for f in regression.ladder(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"]) if f.form == "quadratic"]
    return rounded(regression.fits_frame(spark, fits).select("form", "r2"))


@query("""WITH g AS (SELECT o_orderpriority AS l, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS m2 FROM orders GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS grand FROM g), r AS (SELECT sum(n * (m - grand)^2) / (sum(n * (m - grand)^2) + sum(m2)) AS r2, sum(n) AS n, count(*) - 1 AS k FROM g, t)
  SELECT 'o_orderpriority' AS predictor, 'categorical' AS form, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - k - 1), 8) AS adj_r2, round((SELECT arg_min(m, l) FROM g), 4) AS intercept FROM r""")
def p15_categorical_fit(spark, sf_dir):
    found = regression.fits_frame(spark, regression.categorical_fits(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])).select("predictor", "form", "r2", "adj_r2", "intercept")
    return rounded(rounded(found, 4, ["intercept"]), 8, ["r2", "adj_r2"])


def worth(spark, sf_dir):
    """Line items with a value that quantity, discount and flag go into."""
    value = F.expr("l_extendedprice + 500 * l_quantity - 40000 * l_discount + if(l_returnflag = 'R', 3000, 0)")
    return table(spark, sf_dir, "lineitem").select(value.alias("worth"), "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")


@query()
def p16_best_fits(spark, sf_dir):
    return regression.fits_frame(spark, regression.best_fits(worth(spark, sf_dir), "worth", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]))


FORMS_SQL = """SELECT '{x}' AS predictor, CAST(n AS BIGINT) AS n, form, r2, 1 - (1 - r2) * (n - 1) / (n - k - 1) AS adj_r2 FROM (
  SELECT n, unnest([{'form': 'linear', 'k': 1, 'r2': lin}, {'form': 'log-x', 'k': 1, 'r2': lg}, {'form': 'quadratic', 'k': 2, 'r2': quad}], recursive := true) FROM (
    SELECT n, lin, CASE WHEN least_x > 0 THEN lg END AS lg, ((p * c - q * b) / (a * c - b * b) * p + (a * q - b * p) / (a * c - b * b) * q) / v AS quad FROM (
      SELECT count(*) AS n, min({x}) AS least_x, regr_r2(worth, {x}) AS lin, regr_r2(worth, ln(CASE WHEN {x} > 0 THEN {x} END)) AS lg, covar_pop(z, z) AS a, covar_pop(z, z*z) AS b, covar_pop(z*z, z*z) AS c, covar_pop(z, worth) AS p, covar_pop(z*z, worth) AS q, var_pop(worth) AS v
      FROM (SELECT *, ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS z FROM w)))) WHERE r2 IS NOT NULL"""
LEVEL_SQL = """SELECT '{x}' AS predictor, CAST(n AS BIGINT) AS n, 'categorical' AS form, r2, 1 - (1 - r2) * (n - 1) / (n - k - 1) AS adj_r2 FROM (SELECT sum(n) AS n, count(*) - 1 AS k, sum(n * (m - grand)^2) / (sum(n * (m - grand)^2) + sum(m2)) AS r2
  FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand FROM (SELECT {x}, count(*) AS n, avg(worth) AS m, var_pop(worth) * count(*) AS m2 FROM w GROUP BY 1)))"""
WORTH_SQL = "SELECT l_extendedprice + 500 * l_quantity - 40000 * l_discount + CASE WHEN l_returnflag = 'R' THEN 3000 ELSE 0 END AS worth, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem"


#: Worth falls below zero, so no form takes its logarithm.
@query(f"WITH w AS ({WORTH_SQL}), f AS ({' UNION ALL '.join([FORMS_SQL.replace('{x}', x) for x in ('l_quantity', 'l_discount', 'l_tax')] + [LEVEL_SQL.replace('{x}', x) for x in ('l_returnflag', 'l_linestatus')])}) SELECT predictor, form, n, round(r2, 7) AS r2, round(adj_r2, 7) AS adj_r2 FROM f QUALIFY row_number() OVER (PARTITION BY predictor ORDER BY adj_r2 DESC) = 1")
def p16_best_forms(spark, sf_dir):
    fits = regression.best_fits(worth(spark, sf_dir), "worth", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])
    return rounded(regression.fits_frame(spark, fits).select("predictor", "form", "n", "r2", "adj_r2"), 7)


@query()
def p17_model(spark, sf_dir):
    rows = worth(spark, sf_dir)
    made = model.fit_multivariate(rows, "worth", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["l_returnflag"])
    found = []
    if made:  # else nothing is better than the mean
        m, columns = made
        d = model.diagnose(rows, m, columns)
        found = [(p, m.coefficients[p], m.p_values[p], m.std_coefficients.get(p), m.vif.get(p), p in m.weak, m.adj_r2, d.verdict) for p in ["intercept", *m.predictors]]
    return spark.createDataFrame(found, "predictor string, coefficient double, p_value double, std_coefficient double, vif double, weak boolean, adj_r2 double, verdict string")


@query()
def p22_pca(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return model.pca_scores(lines.select("l_orderkey", "l_linenumber", *NUMBERS), model.run_pca(lines, NUMBERS)).select("l_orderkey", "l_linenumber", "pc1", "pc2")


@query()
def p23_scan(spark, sf_dir):
    return scan.scan(worth(spark, sf_dir), "worth").frame(spark)


FLAGS, WORTHS = ["l_returnflag", "l_linestatus"], ["worth", "l_quantity", "l_discount", "l_tax"]
PAIR_SQL = (
    [f"SELECT a, b, 'correlation' AS kind, printf('Where %s is higher, %s tends to be %s (r = %+.2f; %.0f%% of the variation is shared).', a, b, CASE WHEN r >= 0 THEN 'higher' ELSE 'lower' END, r, 100 * r * r) AS headline, '|r|' AS effect_name, p, abs(r) AS effect, n FROM ({filled(PEARSON_SQL.replace(' AS p_value', ' AS p').replace('FROM lineitem', 'FROM w'), a=a, b=b)})" for i, a in enumerate(WORTHS) for b in WORTHS[i + 1 :]]
    + [f"SELECT a, b, 'group-difference', printf('The average of %s differs between the groups of %s, which go with %.0f%% of its variation.', a, b, 100 * eta), 'eta squared', p, eta, n FROM ({filled(ANOVA_SQL, a=a, b=b, t='w')})" for a in WORTHS for b in FLAGS]
    + [f"SELECT a, b, 'association', printf('%s and %s are not independent (Cramer''s V = %.2f).', a, b, v), 'Cramer''s V', p, v, n FROM ({filled(CHI_SQL, a=FLAGS[0], b=FLAGS[1], t='w')})"]
)
FINDING_SQL = f"""WITH w AS ({WORTH_SQL}) SELECT kind, CASE kind WHEN 'group-difference' THEN a || ' by ' || b ELSE a || ' and ' || b END AS title, headline, effect_name, round(effect, 6) AS effect, CASE WHEN effect >= 0.5 THEN 'strong' WHEN effect >= 0.3 THEN 'moderate' WHEN effect >= 0.1 THEN 'weak' ELSE 'negligible' END AS strength, round(q, 7) AS q_value, q <= 0.05 AS significant, n
  FROM (SELECT *, least(1, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM ({' UNION ALL '.join(PAIR_SQL)})))"""


@query(FINDING_SQL)
def p24_findings(spark, sf_dir):
    """What a scan without a target says of all pairs, found or rejected."""
    result = scan.scan(worth(spark, sf_dir).select(*WORTHS, *FLAGS))
    told = result.frame(spark).withColumn("significant", F.lit(True)).unionByName(result.frame(spark, False).withColumn("significant", F.lit(False)))
    return rounded(rounded(told.select("kind", "title", "headline", "effect_name", "effect", "strength", "q_value", "significant", "n"), 6, ["effect"]), 7, ["q_value"])


@query(f"SELECT 'lines' AS dataset, CAST(NULL AS VARCHAR) AS target, 42 AS seed, kind, title, strength, q_value, n FROM ({FINDING_SQL}) WHERE significant")
def p25_saved_pairs(spark, sf_dir):
    """The findings of all pairs, written with their lineage and read back."""
    path = scratch_path(spark, "findings")
    scan.save_findings(spark, scan.scan(worth(spark, sf_dir).select(*WORTHS, *FLAGS), name="lines"), path)
    return rounded(spark.read.parquet(path).select("dataset", "target", "seed", "kind", "title", "strength", "q_value", "n"), 7)


# --- charts -----------------------------------------------------------------------


@query("SELECT p_type AS x, NULL AS series, round(sum(p_retailprice), 2) AS y FROM part GROUP BY 1 ORDER BY round(sum(p_retailprice), 2) DESC, 1 LIMIT 30")
def v1_bar(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long"))
    return charts.chart(part, charts.ChartSpec("bar", "p_type", "cents")).df.withColumn("y", F.round(F.col("y") / 100, 2))


ORACLE_SQL["v1_bar"] = "SELECT p_type AS x, CAST(NULL AS VARCHAR) AS series, round(sum(CAST(round(p_retailprice * 100) AS BIGINT)) / 100, 2) AS y FROM part GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 30"


@query("WITH g AS (SELECT CAST(o_orderdate AS DATE) AS x, o_orderstatus AS series, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY ALL) SELECT * FROM g WHERE x IN (SELECT DISTINCT x FROM g ORDER BY x LIMIT 30)")
def v2_line(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return charts.chart(orders, charts.ChartSpec("line", "day", "", "o_orderstatus", "count")).df


@query("SELECT p_brand AS x, p_size::VARCHAR AS series, round(median(p_retailprice), 4) AS y FROM part WHERE p_brand IS NOT NULL GROUP BY ALL ORDER BY y DESC, x, series LIMIT 30")
def v1_median_bar(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return rounded(charts.chart(part, charts.ChartSpec("bar", "p_brand", "p_retailprice", "p_size", "median")).df, 4)


@query("SELECT least(count(*), 5000) AS n FROM lineitem")
def v3_scatter(spark, sf_dir):
    return charts.chart(table(spark, sf_dir, "lineitem"), charts.ChartSpec("scatter", "l_quantity", "l_extendedprice", "l_returnflag")).df.agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT event_type AS x, count(*) AS n, min(value) AS q0, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS q4 FROM events WHERE value IS NOT NULL GROUP BY 1 ORDER BY n DESC, x LIMIT 16),
  e AS (SELECT q.x, min(value) FILTER (i) AS low, max(value) FILTER (i) AS high, count(*) FILTER (NOT i) AS outliers FROM (SELECT event_type AS x, value FROM events WHERE value IS NOT NULL) v JOIN q USING (x), LATERAL (SELECT value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS i) GROUP BY 1)
  SELECT x, n, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(q4, 6) AS q4, round(low, 6) AS low, round(high, 6) AS high, outliers FROM q JOIN e USING (x)""")
def v4_box(spark, sf_dir):
    return rounded(charts.chart(table(spark, sf_dir, "events"), charts.ChartSpec("box", "event_type", "value")).df)


@query("""WITH b AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z, CAST(greatest(8, least(40, floor(sqrt(count(*))))) AS INTEGER) AS k FROM orders), w AS (SELECT *, (z - a) / k AS w FROM b)
  SELECT CAST(i AS INTEGER) AS bin, (SELECT count(*) FROM orders WHERE least(floor((o_totalprice - a) / w), k - 1) = i) AS n FROM w, LATERAL (SELECT unnest(range(k)) AS i)""")
def v5_histogram(spark, sf_dir):
    return charts.chart(table(spark, sf_dir, "orders"), charts.ChartSpec("histogram", "o_totalprice")).df.select("bin", "n")


@query("WITH g AS (SELECT c_mktsegment AS x, round(avg(c_acctbal - 4500), 2) AS y FROM customer GROUP BY 1) SELECT x, y, (SELECT count(*) FROM g WHERE y <= 0) AS left_out FROM g WHERE y > 0")
def v6_log_scale(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("net", F.col("c_acctbal") - 4500)
    shown = charts.chart(customers, charts.ChartSpec("bar", "c_mktsegment", "net", agg="mean", y_scale="log"))
    gone = int(shown.notes[0].split(" ")[0]) if shown.notes else 0
    return shown.df.select("x", F.round("y", 2).alias("y")).withColumn("left_out", F.lit(gone).cast("long"))


@query("""WITH g AS (SELECT p_size AS x, p_brand AS s, CAST(count(*) AS DOUBLE) AS y FROM part GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY y DESC, x, s) AS k FROM g QUALIFY k <= 200), f AS (SELECT s, row_number() OVER (ORDER BY min(k)) AS r FROM o GROUP BY s)
  SELECT x, CASE WHEN r > 8 THEN 'Other' ELSE s END AS series, y FROM o JOIN f USING (s)""")
def v7_fold_series(spark, sf_dir):
    return charts.fold_series(charts.chart(table(spark, sf_dir, "part"), charts.ChartSpec("bar", "p_size", "", "p_brand", "count", limit=200)).df)


# --- sources and sinks ---------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s1_k1_csv_round_trip(spark, sf_dir):
    path = scratch_file(spark, "orders.csv")
    files.write_file(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "csv", dry_run=False)
    return files.read_file(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("SELECT p_partkey, p_name, p_size FROM part")
def s2_json_lines(spark, sf_dir):
    path = scratch_file(spark, "part.jsonl")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.json(path)
    return files.read_file(spark, path, "p_partkey bigint, p_name string, p_size int")


@query("SELECT * FROM supplier")
def k2_table_round_trip(spark, sf_dir):
    name = f"loomwork_supplier_{uuid.uuid4().hex[:12]}"
    files.write_table(table(spark, sf_dir, "supplier"), name, dry_run=False)
    return spark.table(name)


@query("SELECT count(*) AS attempted, 0 AS written, count(*) AS skipped FROM orders")
def k3_dry_run(spark, sf_dir):
    report = files.write_file(table(spark, sf_dir, "orders"), scratch_path(spark, "none"))
    return spark.createDataFrame([(report.attempted, report.written, report.skipped)], "attempted long, written int, skipped long")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def s5_page(spark, sf_dir):
    return files.page(table(spark, sf_dir, "orders"), ["o_orderkey"], 100, 50).select("o_orderkey", "o_totalprice")


@query("SELECT c_name, c_acctbal FROM customer")
def s6_derive(spark, sf_dir):
    return files.derive(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def s7_json_records(spark, sf_dir):
    docs = records.parse_documents(table(spark, sf_dir, "events"), "props", "struct<k:bigint>")
    return records.to_table(docs, "", {"k": "k", "missing": "a.b[0]"}, "props", ("event_id",))


@query("SELECT o_custkey, o_orderkey AS id, o_totalprice AS \"info.price\", '[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' AS tags FROM orders")
def s8_json_flatten(spark, sf_dir):
    item = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_totalprice").alias("price")).alias("info"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    docs = parts_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").groupBy("o_custkey", "start").agg(F.struct(F.collect_list(item).alias("items"), F.count("*").alias("total")).alias("body"))
    return records.to_table(docs, "items", None, "body", ("o_custkey",))


@query("SELECT 'items' AS path, unnest(['id', 'info_price', 'tags']) AS name, unnest(['id', 'info.price', 'tags']) AS leaf")
def s9_infer_mapping(spark, sf_dir):
    item = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_totalprice").alias("price")).alias("info"), F.array("o_orderstatus").alias("tags"))
    text = parts_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").groupBy("o_custkey", "start").agg(F.to_json(F.struct(F.collect_list(item).alias("items"), F.count("*").alias("total"))).alias("body"))
    path, columns = records.infer_mapping(records.parse_documents(text, "body"), "body")
    return spark.createDataFrame([(path, n, leaf) for n, leaf in columns.items()], "path string, name string, leaf string")


@query("""SELECT p_brand AS page_id, 'Parts of ' || p_brand AS table_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_index, CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_type AS name_2 FROM part""")
def s10_html_tables(spark, sf_dir):
    """Each brand's parts as pages with a table, read back; the header has footnotes and a repeated name."""
    row = F.concat(F.lit("<tr><td>"), F.col("p_partkey").cast("string"), F.lit("</td><td>"), F.col("p_name"), F.lit(" [1]</td><td>"), F.col("p_type"), F.lit("</td></tr>"))
    bodies = parts_of(table(spark, sf_dir, "part"), "p_brand", "p_partkey").groupBy("p_brand", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    html = F.concat(F.lit("<nav><table><tr><td>a</td><td>b</td></tr></table></nav><h2>Parts of "), F.col("p_brand"), F.lit("</h2><table><tr><th>key[a]</th><th>name</th><th>name [2]</th></tr>"), F.col("rows"), F.lit("</table>"))
    found = pages.extract_tables(bodies.select(F.concat(F.col("start").cast("string"), F.lit("/"), F.col("p_brand")).alias("page_id"), html.alias("html")))
    start, brand = F.regexp_extract("page_id", "^([0-9]+)/", 1).cast("long"), F.regexp_replace("page_id", "^[0-9]+/", "")
    return found.select(brand.alias("page_id"), "table_name", (start + F.col("row_index")).alias("row_index"), *[F.element_at("cells", n).alias(n) for n in ("key", "name", "name_2")])


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\[\s*[a-zA-Z0-9]{1,3}\s*\]', '', 'g'), '\s+', ' ', 'g')) AS title, len(string_split(html, '<p>')) > 1 AS has_text FROM pages""")
def s12_articles(spark, sf_dir):
    return pages.extract_articles(table(spark, sf_dir, "pages")).select("page_id", "title", (F.col("text") != "").alias("has_text"))


@query(r"""SELECT page_id, 'article' AS kind, CAST(NULL AS INTEGER) AS table_index, regexp_replace(regexp_replace(lower(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)', 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS dataset FROM pages""")
def s13_dataset_names(spark, sf_dir):
    return pages.dataset_names(table(spark, sf_dir, "pages"))


@query("SELECT p_partkey, 'https://api.example.com/parts/' || p_partkey || '?n=' || replace(replace(p_brand, '%', '%25'), '#', '%23') || '&t=' || replace(p_type, ' ', '%20') AS url FROM part ORDER BY p_partkey LIMIT 1000")
def k4_push_plan(spark, sf_dir):
    spec = push.PushSpec("https://api.example.com/parts/{p_partkey}?n={p_brand}&t={p_type}", "PUT", "p_partkey")
    requests, _, _ = push.push_plan(table(spark, sf_dir, "part"), spec, ["p_partkey"])
    return requests.select(F.get_json_object("body", "$.p_partkey").cast("long").alias("p_partkey"), "url")


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS idempotency_key FROM nation""")
def k5_idempotency(spark, sf_dir):
    spec = push.PushSpec("https://api.example.com/nations", "POST", mode="per_row", post_acknowledged=True)
    requests, _, _ = push.push_plan(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), spec, ["n_nationkey"])
    return requests.select(F.get_json_object("body", "$.n_nationkey").cast("int").alias("n_nationkey"), "idempotency_key")


@query("SELECT l_orderkey, l_linenumber, 'a value the URL needs is missing' AS message FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000) WHERE l_returnflag = 'R'")
def k6_failures(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.nullif("l_returnflag", F.lit("R")).alias("flag"))
    _, failures, _ = push.push_plan(lines, push.PushSpec("http://x/{key}/{flag}", "PUT", "key"), ["l_orderkey", "l_linenumber"])
    part = F.split("key", "-")
    return failures.select(part[0].cast("long").alias("l_orderkey"), part[1].cast("int").alias("l_linenumber"), "message")


@query("SELECT l_returnflag AS x, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY 1")
def k7_chart_export(spark, sf_dir):
    path = scratch_file(spark, "chart.csv")
    files.write_chart(charts.chart(table(spark, sf_dir, "lineitem"), charts.ChartSpec("bar", "l_returnflag", agg="count")), path)
    return files.read_file(spark, path, "x string, series string, y double").select("x", "y")




# --- whole flows, models and dashboards ------------------------------------------------


def _part_flow(sf_dir: str, out: str) -> flow.Flow:
    doc = {"fields": [{"target": "id", "sources": ["p_partkey"]}, {"target": "label", "sources": ["p_brand", "p_type"], "join_with": ": "}, {"target": "price", "sources": ["p_retailprice"], "type": "DECIMAL(10,1)"}]}
    return flow.flow_with_mapping(f"{sf_dir}/part.parquet", doc, out)


@query("SELECT p_partkey AS id, p_brand || ': ' || p_type AS label, CAST(p_retailprice AS DECIMAL(10,1)) AS price FROM part")
def n15_map_fields(spark, sf_dir):
    return _part_flow(sf_dir, "none").frame(spark, "map")


@query("SELECT p_partkey AS id, p_brand || ': ' || p_type AS label, CAST(p_retailprice AS DECIMAL(10,1)) AS price, (SELECT count(*) FROM part) AS written FROM part")
def f4_run_outputs(spark, sf_dir):
    path = scratch_path(spark, "parts")
    report = flow.run_outputs(spark, _part_flow(sf_dir, path))["out"]
    return spark.read.parquet(path).withColumn("written", F.lit(report.written).cast("long"))


@query("SELECT o_orderkey, o_totalprice, 2 AS sinks, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS written, (SELECT least(1000, count(*)) FROM orders WHERE o_totalprice > 200000) AS planned FROM orders WHERE o_totalprice > 200000")
def n16_table_and_request_sinks(spark, sf_dir):
    """One flow into a table and into planned requests; the table is replaced, the requests are a dry run of their own."""
    made = flow.Flow().add("in", "input_file", {"path": f"{sf_dir}/orders.parquet"}).add("large", "filter", {"expression": "o_totalprice > 200000"}).add("kept", "select", {"keep": ["o_orderkey", "o_totalprice"]})
    made.add("table", "output_dataset", {"table": "loomwork_large_orders"}).add("rest", "output_rest", {"url_template": "https://api.example.com/orders/{o_orderkey}", "method": "PUT", "key_column": "o_orderkey", "order": ["o_orderkey"]})
    made.connect("in", "large").connect("large", "kept").connect("kept", "table").connect("kept", "rest")
    reports = flow.run_outputs(spark, made, ["table"], allow_writes=True) | flow.run_outputs(spark, made, ["rest"], dry_run=True)
    found = spark.table("loomwork_large_orders")
    return found.withColumns({"sinks": F.lit(len(reports)), "written": F.lit(reports["table"].written).cast("long"), "planned": F.lit(reports["rest"].attempted).cast("long")})


@query("SELECT c_custkey, c_mktsegment FROM customer")
def f5_generated_flow(spark, sf_dir):
    path = scratch_path(spark, "customers")
    flow.run_outputs(spark, flow.flow_from_columns(f"{sf_dir}/customer.parquet", ["c_custkey", "c_mktsegment"], path))
    return spark.read.parquet(path)


@query("SELECT count(*) AS total, least(count(*), 500) AS shown, 'n_name,revenue,ship_year' AS columns FROM (SELECT n_name, year(l_shipdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL)")
def f3_preview(spark, sf_dir):
    doc = flagship_doc(sf_dir)
    doc["nodes"][-2]["params"]["group_by"] = ["n_name", "ship_year"]
    schema, total, first = flow.preview(spark, flow.Flow.from_doc(doc), "sums")
    return spark.createDataFrame([(total, first.count(), ",".join(sorted(c for c, _ in schema)))], "total long, shown long, columns string")


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderstatus <> 'F') AS done__lost_cast, count(*) AS word__lost, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS name__unmatched, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders")
def m5_stream_losses(spark, sf_dir):
    """Orders as a stream, mapped batch by batch; counters and rows of all batches."""
    done, pairs_of = steps(("replace", {"find": "F", "with": "1"}), ("cast", {"type": "BIGINT"})), [["1-URGENT", "urgent"], ["2-HIGH", "high"]]
    doc = mapping.MappingDoc.from_dict({"fields": [{"target": "done", "sources": ["o_orderstatus"], "steps": done}, {"target": "word", "sources": ["o_orderpriority"], "type": "BIGINT"}, {"target": "name", "sources": ["o_orderpriority"], "steps": steps(("lookup", {"pairs": pairs_of}))}]})
    path, orders = scratch_path(spark, "stream"), table(spark, sf_dir, "orders")
    arriving = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]")  # a pattern: a table may be one file
    losses.write_mapped(arriving, doc, path, f"{path}/checkpoint").awaitTermination()
    counted = losses.read_mapped(spark, path).agg(F.count("done").alias("done"))
    return losses.read_losses(spark, path).crossJoin(F.broadcast(counted))  # one row each


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def m7_inline_lookup(spark, sf_dir):
    fields = [{"target": "o_orderkey", "sources": ["o_orderkey"]}, {"target": "status", "sources": ["o_orderstatus"], "steps": steps(("lookup", {"pairs": [["F", "done"], ["O", "open"], ["F", "again"]]}))}]
    return mapping.apply_mapping(table(spark, sf_dir, "orders"), mapping.MappingDoc.from_dict({"fields": fields}))


@query("SELECT p_name AS before, substr(upper(p_name), 1, 6) AS after FROM part")
def m8_preview(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    doc = {"fields": [{"target": "short", "sources": ["p_name"], "steps": steps(("upper",), ("truncate", {"length": 6}))}]}
    return mapping.preview(parts, mapping.MappingDoc.from_dict(doc), "short", rows=2**31 - 1)


MIXED = "SELECT l_quantity AS x, l_extendedprice + 500 * l_quantity AS y FROM lineitem"


def mixed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") + 500 * F.col("l_quantity")).alias("y"))


@query(f"SELECT 'x' AS predictor, round(regr_slope(y, x), 4) AS coefficient, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 8) AS r2, round(sqrt(regr_r2(y, x)), 8) AS std_coefficient, count(*) AS n FROM ({MIXED})")
def p18_final_model(spark, sf_dir):
    m, _ = model.fit_multivariate(mixed(spark, sf_dir), "y", ["x"], [])
    rows = [(p, round(m.coefficients[p], 4), round(m.coefficients["intercept"], 2), round(m.r2, 8), round(m.std_coefficients[p], 8), m.n) for p in m.predictors]
    return spark.createDataFrame(rows, "predictor string, coefficient double, intercept double, r2 double, std_coefficient double, n long")


@query("SELECT round(1 / (1 - corr(l_quantity, l_extendedprice)^2), 6) AS vif FROM lineitem")
def p19_vif(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    n, mean, s = moments.gram(lines, [pairs.number(c) for c in names], 1).total()
    m = model.solved(s, mean, n, [0, 1], 2, names, "l_tax")
    return spark.createDataFrame([(round(m.vif["l_quantity"], 6),)], "vif double")


@query(f"""WITH d AS ({MIXED}), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n FROM d),
  e AS (SELECT x, y - a - b * x AS e, 1 / n + (x - mx)^2 / sxx AS h, n FROM d, m), v AS (SELECT avg(e^2) AS m2, sum(e^2) / (any_value(n) - 2) AS s2 FROM e)
  SELECT CAST(any_value(n) AS BIGINT) AS n, round(any_value(n) / 6 * ((avg(e^3) / any_value(m2)^1.5)^2 + (avg(e^4) / any_value(m2)^2 - 3)^2 / 4), 4) AS jarque_bera, round(any_value(n) * corr(e^2, x)^2, 4) AS breusch_pagan,
    count(*) FILTER (e^2 / (2 * s2) * h / (1 - h)^2 > 4 / n) AS influential FROM e, v""")
def p21_diagnostics(spark, sf_dir):
    rows = mixed(spark, sf_dir)
    m, columns = model.fit_multivariate(rows, "y", ["x"], [])
    d = model.diagnose(rows, m, columns)
    return spark.createDataFrame([(d.n, round(d.jarque_bera, 4), round(d.breusch_pagan, 4), d.influential)], "n long, jarque_bera double, breusch_pagan double, influential long")


@query()
def p25_saved_findings(spark, sf_dir):
    """Findings written with their lineage and read back."""
    result = scan.scan(mixed(spark, sf_dir), "y", name="mixed")
    path = scratch_path(spark, "findings")
    scan.save_findings(spark, result, path)
    return spark.read.parquet(path).select("dataset", "target", "seed", "kind", "title", "n")


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
def s3_parquet_and_catalog(spark, sf_dir):
    held = files.Catalog(spark)
    held.open_file(f"{sf_dir}/nation.parquet", name="loomwork_nation")
    return held.get("loomwork_nation").unionAll(spark.sql("SELECT * FROM loomwork_nation WHERE n_regionkey = 1"))


@query("SELECT 0 AS chart, o_orderpriority AS x, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 2 UNION ALL SELECT 1, p_brand, max(p_retailprice) FROM part GROUP BY 2 ORDER BY 1, 3 DESC, 2 LIMIT 1000")
def v9_dashboard(spark, sf_dir):
    board = charts.Dashboard()
    board.add(charts.ChartSpec("bar", "o_orderpriority", agg="count", dataset="orders"))
    board.add(charts.ChartSpec("bar", "p_brand", "p_retailprice", agg="max", limit=1000, dataset="part"))
    shown = board.evaluate({n: table(spark, sf_dir, n) for n in board.needs()})
    return shown[0].df.select(F.lit(0).alias("chart"), "x", "y").unionAll(shown[1].df.select(F.lit(1).alias("chart"), "x", "y"))
