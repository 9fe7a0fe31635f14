"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardtide.llm.shared import materialised


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) of every node that has an edge to another.

    ``edges`` has two long columns; nulls, loops and repeated edges are ignored, and an empty table gives an
    empty result. Each round joins the edges with one minimum per node. The minima are written first, so that
    the join's two sides are plain exchanges and a hub with a large share of the edges can be split.
    """
    a, b = edges.columns
    now = materialised(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = materialised(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")))
        large = materialised(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        )
        least = materialised(large.groupBy("u").agg(F.min("v").alias("least")))
        joined = large.join(least, "u")
        now = materialised(
            joined.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(least.select("u", F.col("least").alias("v")))
            .distinct()
        )
        before, state = state, _state(now)
        if state == before:
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(members.select("component", "component").distinct())
