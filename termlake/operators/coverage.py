"""Coverage grid: a cell for every observed label and column, counted or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import MIN_N


def coverage_grid(base: DataFrame, label: str, column: str, min_n: int = MIN_N) -> DataFrame:
    """label, column, n, reportable and note; the axes are the observed values, NULL as ``unclassified``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unclassified"))
    counts = base.groupBy(name(label).alias("label"), name(column).alias("column")).agg(F.count("*").alias("n"))
    # Both axes are distinct values of grouped counts; the grid they span is the result itself.
    grid = counts.select("label").distinct().crossJoin(counts.select("column").distinct())
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    note = F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(f": insufficient (threshold {min_n})"))
    filled = grid.join(counts, ["label", "column"], "left").withColumn("n", n)
    return filled.withColumn("reportable", F.col("n") >= min_n).withColumn("note", F.when(~F.col("reportable"), note))


def coverage_totals(grid: DataFrame) -> DataFrame:
    """Row, column and grand totals with thin and empty cells, in one pass over the grid."""
    sets = grid.groupingSets([["label"], ["column"], []], "label", "column").agg(
        F.sum("n").cast("bigint").alias("total_n"), F.count_if(~F.col("reportable")).alias("thin_cells"), F.count_if(F.col("n") == 0).alias("empty_cells"),
        F.grouping_id("label", "column").alias("g"),
    )
    kind = F.when(F.col("g") == 1, "row").when(F.col("g") == 2, "column").otherwise("grand")
    return sets.select(kind.alias("kind"), F.coalesce("label", "column", F.lit("")).alias("name"), "total_n", "thin_cells", "empty_cells")
