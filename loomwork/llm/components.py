"""Connected components by alternating large-star and small-star steps, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``(u, v)`` of any one orderable type to ``(node, root)``, root being the least node of the component.

    Every round is two aggregations with a map-side minimum and two joins that
    adaptive execution may split, so a hub with a third of all edges is no
    single task's work. A round ends in a table in the shared folder, and the
    table of the round before is deleted.
    Self-loops and repeated edges are allowed; edges with a null end are left
    out; nodes without an edge have no row; an empty input gives no row.
    """
    spark = edges.sparkSession
    now, path = stored(edges.select("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        nxt, written = stored(_small_star(_large_star(now)), "components")
        after = _state(nxt)
        discard(spark, path)
        now, path, settled, state = nxt, written, after == state, after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
