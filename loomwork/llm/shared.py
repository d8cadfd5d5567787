"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.scratch import discard, materialize, scratch, scratch_path, shared_dir, stored

__all__ = ["discard", "fold_of", "materialize", "numbered", "pick", "scratch", "scratch_path", "shared_dir", "stored", "table", "utf8", "words_of"]

LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and where each name is now, lower-cased names too: exact spelling first, then the first alike.

    Columns whose names differ in case only, or not at all, are told apart.
    """
    at = {}
    for k, name in reversed(list(enumerate(df.columns))):
        at[name.lower()] = f"c{k}"
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), at | {n: f"c{k}" for k, n in reversed(list(enumerate(df.columns)))}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns of ``df``, whatever else it has."""
    held, at = numbered(df)
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"no column {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return held.select(*[F.col(at[n]).alias(n) for n in names])


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, one at a time; null is the empty text."""
    for value in texts.cast(pa.large_binary()):
        yield value.as_py() or b""


def words_of(text: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: exactly what bytes.split() does."""
    return text.split()
