"""Loss counters of a mapping on a stream that stops, goes on and repeats a batch."""

from pyspark.sql import functions as F

from loomwork.operators import mapping
from loomwork.streaming import losses

DOC = {"fields": [{"target": "n", "sources": ["v"], "type": "BIGINT"}, {"target": "day", "sources": ["d"], "steps": [{"key": "parse_date", "args": {"format": "%Y-%m-%d"}}]}, {"target": "v2", "sources": ["v"], "steps": [{"key": "lookup", "args": {"pairs": [["1", "one"], ["2", "two"]]}}]}]}


def rows(spark, start, stop):
    return spark.range(start, stop).select(F.when(F.col("id") % 3 == 0, "x").otherwise((F.col("id") % 5).cast("string")).alias("v"), F.when(F.col("id") % 4 == 0, "2024-13-01").otherwise("2024-01-31").alias("d"))


def test_totals_survive_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    doc = mapping.MappingDoc.from_dict(DOC)
    rows(spark, 0, 40).write.parquet(source)
    stream = spark.readStream.schema("v string, d string").parquet(source)
    losses.write_mapped(stream, doc, out, checkpoint).awaitTermination()
    first = losses.read_losses(spark, out).first()
    assert first.asDict() == mapping.loss_counters(rows(spark, 0, 40), doc).withColumn("rows", F.lit(40)).select("rows", *first.asDict().keys() - {"rows"}).first().asDict()
    rows(spark, 40, 90).write.mode("append").parquet(source)
    for _ in range(2):  # the second time nothing is new
        losses.write_mapped(spark.readStream.schema("v string, d string").parquet(source), doc, out, checkpoint).awaitTermination()
    # A batch that is tried again replaces itself.
    losses.write_batch(rows(spark, 40, 90), 1, doc, out)
    total = losses.read_losses(spark, out).first().asDict()
    want = mapping.loss_counters(rows(spark, 0, 90), doc).first().asDict() | {"rows": 90}
    assert total == want and total["n__lost"] == 30 and total["day__lost_parse_date"] == 23 and total["v2__unmatched"] > 0
    got = losses.read_mapped(spark, out)
    assert got.count() == 90 and sorted(map(str, got.collect())) == sorted(map(str, mapping.apply_mapping(rows(spark, 0, 90), doc).collect()))
