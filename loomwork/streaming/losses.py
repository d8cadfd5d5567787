"""Mappings on streams with their loss counters, kept by batch so that a restart counts nothing twice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators import mapping


def write_batch(batch: DataFrame, number: int, doc: mapping.MappingDoc, path: str, crosswalks: Mapping[str, DataFrame] | None = None) -> None:
    """The mapped rows of one batch and, counted by the same write, one row of its counters; both replace what an earlier try of it left."""
    mapped, seen = mapping.apply_observed(batch, doc, crosswalks)
    mapped.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    counts = seen.get
    batch.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"`{c}` long" for c in counts)).write.mode("overwrite").parquet(f"{path}/losses/batch={number}")


def write_mapped(stream: DataFrame, doc: mapping.MappingDoc, path: str, checkpoint: str, crosswalks: Mapping[str, DataFrame] | None = None) -> StreamingQuery:
    """Map what has arrived and stop; with the same checkpoint folder the next call goes on where this ended.

    Rows are under ``path``/rows and counters under ``path``/losses, by batch:
    a batch that ran before a crash runs again with its number.
    """
    doc.validate(stream.columns)
    return stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, doc, path, crosswalks)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_mapped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """One row: the rows and losses of all batches, as mapping.loss_counters() would count them over all that was mapped."""
    held = spark.read.parquet(f"{path}/losses").drop("batch")
    return held.agg(*[F.sum(f"`{c}`").alias(c) for c in held.columns])
