"""Flows over streams: the row-wise steps of a flow on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomwork.plans.flow import NODE_TYPES

#: Steps that look at one row at a time; others need a whole table.
ROWWISE = ("select", "filter", "calculated", "clean_nulls", "unpivot", "map_fields")


def apply_steps(stream: DataFrame, steps: Sequence[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Row-wise steps in order on a stream, or on a table just the same; any other step is refused."""
    for kind, params in steps:
        if kind not in ROWWISE:
            raise ValueError(f"{kind!r} needs a whole table; on a stream there are: {', '.join(ROWWISE)}")
        stream = NODE_TYPES[kind].run(stream, **params)
    return stream


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived as Parquet and stop; with the same checkpoint folder the next call goes on where this ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
