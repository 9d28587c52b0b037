"""Exact order statistics of groups of any size: counts by value, then selection by rank over ranges of values.

No task holds a group: rows are first counted by group and value, the counts are dealt out by ranges of (group, value),
the sizes of the ranges tell which ones hold a wanted rank, and only those are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored


def _same(left: str, right: str, columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


def value_at_ranks(facts: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """The group, ``rank`` (from 0, NULL values left out) and ``value`` at the ranks around each share of the way from first to last."""
    spark = facts.sparkSession
    counts = facts.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged, path = stored(counts.repartitionByRange(*[F.col(c) for c in [*group, "value"]]).withColumn("_part", F.spark_partition_id()), "ranged-counts")
    parts = ranged.groupBy(*group, "_part").agg(F.sum("n").alias("size"))  # a row for each range and group in it
    whole, so_far = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.sum("size").over(whole) - 1
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(s * last), F.ceil(s * last)) for s in map(F.lit, shares)])))
    before = F.coalesce(F.sum("size").over(so_far), F.lit(0))
    held = parts.select(*group, "_part", "size", before.alias("before"), ranks.alias("ranks")).select(
        *group, "_part", "before", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size"))).alias("ranks")
    )
    wanted = held.where(F.size("ranks") > 0)
    own = Window.partitionBy("_part", *group).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.alias("r").join(F.broadcast(wanted.alias("w")), (F.col("r._part") == F.col("w._part")) & _same("r", "w", group))
    placed = inside.select(*[f"r.{c}" for c in [*group, "_part", "value", "n"]], "w.before", "w.ranks").withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    hit = F.filter("ranks", lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("n")))
    found, _ = stored(placed.select(*group, F.explode(hit).alias("rank"), "value"), "values-at-ranks")
    dropped(spark, path)
    return found


def quantiles(facts: DataFrame, group: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """The group, ``numeric_n`` and a column for each of ``names``, interpolated between the two values around its share.

    Groups without a value have no row.
    """
    at = value_at_ranks(facts, group, value, list(names.values()))
    n = facts.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("numeric_n"))
    known = n.alias("n").join(at.alias("a"), _same("n", "a", group)).select(*[f"n.{c}" for c in group], "numeric_n", "rank", "value")
    columns = []
    for name, share in names.items():
        place = F.lit(share) * (F.col("numeric_n") - 1)
        low, high = (F.max(F.when(F.col("rank") == edge, F.col("value").cast("double"))) for edge in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        columns.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return known.groupBy(*group).agg(F.max("numeric_n").alias("numeric_n"), *columns)
