"""The registered query of op2 takes most records through reassembly."""

import base64
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loomwork.llm import queries, warc

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")
def test_most_records_are_segmented(spark, monkeypatch):
    paths, real = [], warc.read_pages
    monkeypatch.setattr(warc, "read_pages", lambda spark, path, *a, **b: (paths.append(path), real(spark, path, *a, **b))[1])
    got = {r["page_id"]: r for r in queries.op2_warc_segments(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        html = (r["html"] or "").encode()
        assert got[r["page_id"]]["payload_bytes"] == len(html)
        assert got[r["page_id"]]["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
    records = warc.read_archives(spark, paths[0])
    whole = records.filter("type = 'response' and number is null").count()
    assert records.filter("number is not null").select(F.col("origin")).distinct().count() > whole


def test_copies_of_one_record_do_not_meet(spark, tmp_path):
    """One page archived 3,000 times, in segments: a group holds its segments once."""
    page, other = "<p>" + "hot page " * 1_000, "<i>" + "other " * 2_000
    pages = spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string").crossJoin(spark.range(3_000)).drop("id")
    pages = pages.unionByName(spark.createDataFrame([(2, "http://b.example/", other), (3, None, other), (4, None, None)], pages.schema)).repartition(8)
    path = f"{tmp_path}/archives"
    warc.write_archives(pages, path, segment=1_024, archive_records=2_000)
    records = warc.read_archives(spark, path)
    parts = warc.one_of_each(records.filter("number is not null").select("origin", "number", "total", "digest", "block_hash", "payload"))
    sizes = {r["origin"]: (r["count"], r["n"]) for r in parts.groupBy("origin").agg(F.count("*").alias("count"), F.max("n").alias("n")).collect()}
    assert max(count for count, _ in sizes.values()) < 20 and max(n for _, n in sizes.values()) == 3_000
    got = warc.read_pages(spark, path, pages.schema["page_id"].dataType, payloads=True)
    assert got.groupBy("page_id").count().orderBy("page_id").collect() == [(1, 3_000), (2, 1), (3, 1), (4, 1)]
    assert {bytes(r["payload"]).decode() for r in got.filter("page_id = 1").select("payload").distinct().collect()} == {page}


def test_segments_in_two_forms_or_missing_are_errors(spark):
    columns = "type string, origin string, number int, total long, digest string, block_hash binary, payload binary"
    block = lambda number, total, data: ("continuation", "x", number, total, None, hashlib.sha256(data).digest(), data)
    whole = [block(1, None, b"HTTP/1.1 200 OK\r\n\r\nab"), block(2, 23, b"cd")]
    assert [bytes(r["payload"]) for r in warc.reassembled(spark.createDataFrame(whole * 2, columns)).collect()] == [b"abcd"] * 2
    for bad in (whole + [block(2, 23, b"ce")], whole * 2 + whole[:1], whole[:1]):
        with pytest.raises(Exception, match="two forms|missing|declared"):
            warc.reassembled(spark.createDataFrame(bad, columns)).collect()
