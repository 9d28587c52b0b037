"""Evaluation analytics: graded predictions, set metrics, ranked retrieval, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import wilson
from .gates import MIN_CONFIDENCE


def calibration(predictions: DataFrame, truth: DataFrame, on: list[str], group: str, floor: float = MIN_CONFIDENCE) -> DataFrame:
    """Per group n, correct, accuracy and Wilson bounds (rounded to 3), and whether the lower bound reaches the floor."""
    right = F.coalesce(F.col("predicted") == F.col("actual"), F.lit(False))
    graded = predictions.join(truth, on, "left").groupBy(group).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return graded.select(
        group, "n", "correct", F.round(F.col("correct") / F.col("n"), 3).alias("accuracy"), F.round(low, 3).alias("ci_low"), F.round(high, 3).alias("ci_high"), (low >= floor).alias("reportable")
    )


def precision_recall(expected: Column, actual: Column) -> tuple[Column, Column]:
    """Of two sets: (1, 1) if both are empty, (0, 0) if one is."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    both, common = (F.size(e) == 0) & (F.size(a) == 0), F.size(F.array_intersect(e, a))

    def part(whole: Column) -> Column:
        return F.when(both, 1.0).when((F.size(e) == 0) | (F.size(a) == 0), 0.0).otherwise(common / F.size(whole))

    return part(a), part(e)


def same_set(expected: Column, actual: Column) -> Column:
    return F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(actual))


def refused_by_grader(measures: Column, dimensions: Column, error: Column) -> Column:
    """The grading page's rule: neither measures nor dimensions, or an error."""
    return error.isNotNull() | ((F.size(measures) == 0) & (F.size(dimensions) == 0))


def refused_by_harness(measures: Column, error: Column) -> Column:
    """The batch harness's rule: no measures, or an error."""
    return error.isNotNull() | (F.size(measures) == 0)


def ranked_metrics(scored: DataFrame, relevant: DataFrame, group: list[str], cut: int = 10) -> DataFrame:
    """Per group recall at 1, 5 and 10 and mean reciprocal rank of each query's first relevant result within ``cut``.

    ``scored``: group columns, query_id, id, score; ``relevant``: query_id, id.
    """
    w = Window.partitionBy(*group, "query_id").orderBy(F.desc("score"), "id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cut)
    hits = top.join(relevant, ["query_id", "id"]).groupBy(*group, "query_id").agg(F.min("rank").alias("rank"))
    asked = scored.select(*group, "query_id").distinct().join(relevant.select("query_id").distinct(), "query_id")
    ranks = asked.join(hits, [*group, "query_id"], "left")
    return ranks.groupBy(*group).agg(
        F.count("*").alias("queries"),
        *[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in (1, 5, 10)],
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def saturated(metrics: DataFrame, template: str, least: float = 0.999) -> DataFrame:
    """Templates on which every method finds the answer first."""
    return metrics.groupBy(template).agg(F.bool_and(F.col("recall_at_1") >= least).alias("saturated"))


def systematic_sample(rows: DataFrame, order: str, want: int = 30, ranges: int = 200) -> DataFrame:
    """Every step-th row by the numeric column ``order``, ``want`` at most; the step comes from the counted rows.

    Equal values are ordered by all columns, NULLs come last. Rows are numbered within value ranges, whose counts
    (``ranges`` rows) give the offsets, so no task sorts all rows unless one value holds them all.
    """
    step = max(1, rows.count() // want)
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + F.coalesce(F.col(order) > cut, F.lit(True)).cast("int")
    placed = rows.withColumn("_range", number)
    running = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(running, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_last(), F.xxhash64(*rows.columns))
    numbered = placed.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(offsets), "_range")
    place = F.col("_before") + F.col("_rn") - 1
    return numbered.where((place % step == 0) & (place < step * want)).select(*rows.columns)


def allowed_answers(facts: DataFrame) -> DataFrame:
    """The distinct answers of each attribute, sorted: what a label may be."""
    distinct = facts.where("position IS NOT NULL").select("deal_point_name", "position").distinct()
    return distinct.groupBy("deal_point_name").agg(F.array_sort(F.collect_set("position")).alias("answers"))


def ingest_statistics(facts: DataFrame) -> DataFrame:
    """One row on a load: facts, those with a place and without, those with a number, distinct names and entities."""
    return facts.agg(
        F.count("*").alias("n"), F.count("span_start").alias("located"), F.count_if(F.col("span_start").isNull()).alias("unlocated"),
        F.count("numeric_value").alias("with_number"), F.count_distinct("deal_point_name").alias("names"), F.count_distinct("matter_id").alias("entities"),
    )


def holdout_by_hash(rows: DataFrame, key: str, want: int = 20) -> DataFrame:
    return rows.orderBy(F.sha2(F.col(key).cast("string"), 256)).limit(want)


def disagreement_queue(predictions: DataFrame) -> DataFrame:
    """Disagreements of the two predictions first, then by id and attribute."""
    out = predictions.withColumn("disagreement", ~F.col("baseline").eqNullSafe(F.col("predicted")))
    return out.orderBy(F.col("disagreement").desc(), "id", "deal_point_name")


def query_templates(entities: DataFrame) -> DataFrame:
    """Three phrasings of a known-item query for each entity with all its parts."""
    full = entities.dropna(subset=["target_name", "acquirer_name", "label", "signing_date"])
    year = F.date_format("signing_date", "yyyy")
    forms = F.array(
        F.struct(F.lit("parties").alias("template"), F.concat_ws(" ", "target_name", "acquirer_name").alias("query")),
        F.struct(F.lit("target_year").alias("template"), F.concat_ws(" ", "target_name", year).alias("query")),
        F.struct(F.lit("industry_year").alias("template"), F.concat_ws(" ", "label", year).alias("query")),
    )
    return full.select("id", F.explode(forms).alias("t")).select("id", "t.template", "t.query")
