"""Small-sample and confidence gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_N = 5
PERCENT_FROM = 10
MIN_CONFIDENCE = 0.7


def refusal(spark: SparkSession, ids: list, min_n: int = MIN_N) -> DataFrame:
    """One row on a set of selected entities: refused or not, decided before any query runs."""
    n = len(set(ids))
    reason = f"n={n} is below the minimum of {min_n}" if n < min_n else None
    return spark.createDataFrame([(n, n < min_n, reason)], "selection_n bigint, refused boolean, reason string")


def refusals(selected: DataFrame, group: str, key: str = "id", min_n: int = MIN_N) -> DataFrame:
    """As ``refusal`` for each of many selections: ``group`` names the selection of a row, ``key`` the selected entity."""
    counted = selected.groupBy(group).agg(F.count_distinct(key).alias("selection_n"))
    small = F.col("selection_n") < min_n
    reason = F.concat(F.lit("n="), F.col("selection_n").cast("string"), F.lit(f" is below the minimum of {min_n}"))
    return counted.select(group, "selection_n", small.alias("refused"), F.when(small, reason).alias("reason"))


def suppress(df: DataFrame, n: str, min_n: int = MIN_N) -> DataFrame:
    return df.where(F.col(n) >= min_n)


def confident(rollup: DataFrame, confidence: DataFrame, floor: float = MIN_CONFIDENCE) -> DataFrame:
    """``rollup`` with its confidence and whether it is gated; an attribute without one is not gated."""
    joined = rollup.join(confidence, "deal_point_name", "left")
    return joined.withColumn("gated", F.coalesce(F.col("confidence") < floor, F.lit(False)))
