"""Rollup of facts by attribute: counts, exact percentiles, distributions, and rows for what is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import render
from ..plans.model import ABSENT_POSITIONS
from ..sources.shared import stored
from .gates import PERCENT_FROM
from .quantiles import quantiles


QUARTILES = {"median_value": 0.5, "p25_value": 0.25, "p75_value": 0.75}


def rollup(facts: DataFrame) -> DataFrame:
    """Per attribute its counts and, only where numbers exist, their exact quartiles.

    The needed columns of the facts are written once, as counts and quartiles both read them.
    """
    present = ~F.col("position").isin(*ABSENT_POSITIONS)
    narrow, _ = stored(
        facts.select("deal_point_name", "matter_id", present.alias("present"), "numeric_value", (~F.col("is_inferred")).alias("expert"), F.col("span_start").isNotNull().alias("spanned")),
        "rollup-facts",
    )
    counts = narrow.groupBy("deal_point_name").agg(
        F.count("*").alias("n"),
        F.count_if("present").alias("present_count"),
        F.count("numeric_value").alias("numeric_n"),
        F.count_if("expert").alias("expert_labelled_n"),
        F.count_if("spanned").alias("with_source_span_n"),
        F.count_distinct("matter_id").alias("matters"),
    )
    quartiles = quantiles(narrow, ["deal_point_name"], "numeric_value", QUARTILES).drop("numeric_n").withColumnRenamed("deal_point_name", "_name")
    joined = counts.join(quartiles, F.col("deal_point_name").eqNullSafe(F.col("_name")), "left")
    return joined.select("deal_point_name", "n", "present_count", "numeric_n", *QUARTILES, "expert_labelled_n", "with_source_span_n", "matters")


def distribution(facts: DataFrame) -> DataFrame:
    return facts.groupBy("deal_point_name", "position").agg(F.count("*").alias("n"))


def absences(vocabulary: DataFrame, answered: DataFrame) -> DataFrame:
    """Attributes of the vocabulary that no selected entity answers, with zero counts."""
    zero = F.lit(0).cast("bigint")
    missing = vocabulary.select("deal_point_name").distinct().join(answered.select("deal_point_name").distinct(), "deal_point_name", "left_anti")
    return missing.select("deal_point_name", zero.alias("n"), zero.alias("present_count"), F.lit("not answered in this selection").alias("reason"))


def deal_terms(facts: DataFrame, vocabulary: DataFrame, selected: DataFrame, selection_n: int, threshold: int = PERCENT_FROM) -> DataFrame:
    """The report on the selected entities: rolled-up attributes, then the absent ones, each with its rendered count."""
    chosen = facts.join(selected, "matter_id", "left_semi")
    rolled = rollup(chosen).withColumn("reason", F.lit(None).cast("string"))
    rows = rolled.unionByName(absences(vocabulary, rolled), allowMissingColumns=True)
    text, kind = render(F.col("present_count"), F.col("n"), F.lit(selection_n), threshold)
    return rows.select("deal_point_name", "n", "present_count", F.coalesce("numeric_n", F.lit(0)).alias("numeric_n"), "median_value", "p25_value", "p75_value", text.alias("rendered"), kind.alias("kind"), "reason")
