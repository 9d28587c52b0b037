"""Connected components of an edge table by alternating stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, persisted


PART_ROWS, LEAST_PARTS = 100_000, 8  # edges of a partition when a round is written; its count is known


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node (the larger ones, or the smaller ones and itself) to its least neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and its component's least node ``label`` for every node of ``edges`` (u, v) but the least ones."""
    now, path = persisted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(now)
    while before[0]:
        parts = max(LEAST_PARTS, before[0] // PART_ROWS)
        new, new_path = persisted(_star(_star(now, True), False).coalesce(parts), "edges")
        after = state(new)
        drop_path(now.sparkSession, path)
        now, path = new, new_path
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
