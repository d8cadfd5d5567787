"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. A local session (tests) that names none gets a folder of its own; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="loomwork-")
        spark.sparkContext.setCheckpointDir(where)
    return where


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path under the shared one; scratch() around the call deletes it."""
    path = f"{shared_dir(spark)}/loomwork/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is not there is fine."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was written inside by scratch_path() and materialize().

    Put it around work whose result is written or collected inside: a result
    that is still to be read needs its scratch tables.
    """
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for path in held:
            discard(spark, path)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """(``df`` written as Parquet in the shared folder and read back, where it is): the lineage ends at files any executor can read."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return stored(df, tag)[0]
