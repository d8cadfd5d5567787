"""Queries that build documents of groups: a group that holds most rows is cut into documents of bounded size."""

import pytest
from pyspark.sql import functions as F

from loomwork import queries
from loomwork.sources import pages, records

MOST = 2 * queries.PART_ROWS if hasattr(queries, "PART_ROWS") else 2000
N = 3001


@pytest.fixture
def hot(spark, tmp_path):
    orders = spark.range(N).select(
        F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(99).alias("o_custkey"), F.col("id").alias("o_orderkey"),
        (F.col("id") / 4).alias("o_totalprice"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    part = spark.range(N).select(F.when(F.col("id") % 100 == 0, "Brand#2").otherwise("Brand#1").alias("p_brand"), F.col("id").alias("p_partkey"), F.concat(F.lit("name "), "id").alias("p_name"), F.lit("type").alias("p_type"))
    part.repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def spy(monkeypatch, module, name, seen):
    real = getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *a, **b: (seen.append(df), real(df, *a, **b))[1])


def test_json_documents_are_bounded(spark, hot, monkeypatch):
    seen = []
    spy(monkeypatch, records, "to_table", seen)
    got = queries.s8_json_flatten(spark, hot).collect()
    assert sorted((r["o_custkey"], r["id"], r["info.price"], r["tags"]) for r in got) == sorted((k % 7 if k % 20 == 0 else 99, k, k / 4, '["O","1-URGENT"]') for k in range(N))
    sizes = [r[0] for r in seen[0].select(F.size("body.items")).collect()]
    assert max(sizes) < MOST and sum(sizes) == N


def test_inferred_documents_are_bounded(spark, hot, monkeypatch):
    seen = []
    spy(monkeypatch, records, "parse_documents", seen)
    assert [tuple(r) for r in queries.s9_infer_mapping(spark, hot).collect()] == [("items", "id", "id"), ("items", "info_price", "info.price"), ("items", "tags", "tags")]
    sizes = [r[0] for r in seen[0].select(F.get_json_object("body", "$.total").cast("long")).collect()]
    assert max(sizes) < MOST and sum(sizes) == N


def test_html_pages_are_bounded(spark, hot, monkeypatch):
    seen = []
    spy(monkeypatch, pages, "extract_tables", seen)
    got = sorted((r["page_id"], r["row_index"], r["key"], r["name"], r["table_name"]) for r in queries.s10_html_tables(spark, hot).collect())
    want = []
    for brand, keys in (("Brand#1", [k for k in range(N) if k % 100]), ("Brand#2", range(0, N, 100))):
        want += [(brand, i, str(k), f"name {k}", f"Parts of {brand}") for i, k in enumerate(keys)]
    assert got == sorted(want)
    sizes = [r[0] for r in seen[0].select(F.size(F.split("html", "<tr><td>")) - 2).collect()]
    assert max(sizes) < MOST and sum(sizes) == N
