"""Drill-through from a figure to the exact text behind it, and the card of one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slice_text

SUMMARY_TERMS = 5


def drill_through(facts: DataFrame, entities: DataFrame, attribute: str, ids: list) -> DataFrame:
    """The facts on ``attribute`` of the chosen entities, with their names."""
    few = facts.where((F.col("deal_point_name") == attribute) & F.col("matter_id").isin(*ids))
    return few.join(entities.select(F.col("id").alias("matter_id"), "target_name", "acquirer_name"), "matter_id").select(
        "matter_id", "target_name", "acquirer_name", "position", "numeric_value", "span_start", "span_end"
    )


def with_span_text(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``facts`` with the text of their span in ``texts`` (matter_id, text), or the reason there is none."""
    piece, reason = slice_text(F.col("text"), F.col("span_start"), F.col("span_end"))
    return facts.join(texts, "matter_id", "left").withColumn("clause_text", piece).withColumn("reason", reason).drop("text")


def matter_cards(entities: DataFrame, facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per entity its fact counts and a paragraph naming parties, industry, date, value and the first terms."""
    ranked = facts.withColumn("rn", F.row_number().over(Window.partitionBy("matter_id").orderBy("deal_point_name")))
    terms = ranked.groupBy("matter_id").agg(
        F.count("*").alias("deal_point_count"),
        F.count("span_start").alias("located_count"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= SUMMARY_TERMS, F.concat_ws(": ", "deal_point_name", "position")))).alias("terms"),
    )
    labels = concepts.select(F.col("code").alias("industry_code"), F.col("label").alias("industry"))
    c = entities.join(labels, "industry_code", "left").join(terms.withColumnRenamed("matter_id", "id"), "id", "left")
    parties = F.when(F.col("acquirer_name").isNotNull(), F.concat_ws(" / ", "acquirer_name", "target_name")).otherwise(F.coalesce("target_name", F.col("id").cast("string")))
    industry = F.when(F.col("industry").isNull(), "industry not classified").when(F.col("is_inferred_industry"), F.concat("industry", F.lit(" (inferred)"))).otherwise(F.col("industry"))
    signed = F.coalesce(F.concat(F.lit(", signed "), F.col("signing_date").cast("string")), F.lit(""))
    value = F.coalesce(F.concat(F.lit("$"), F.bround("deal_value", 0).cast("bigint").cast("string")), F.lit("deal value not available"))
    n, located = F.coalesce("deal_point_count", F.lit(0)), F.coalesce("located_count", F.lit(0))
    said = F.coalesce(F.nullif(F.array_join("terms", "; "), F.lit("")), F.lit("no deal points recorded"))
    summary = F.concat(parties, F.lit(" - "), industry, signed, F.lit(". "), value, F.lit(". Negotiated terms (n="), n.cast("string"), F.lit(", "), located.cast("string"), F.lit(" located): "), said, F.lit("."))
    return c.select("id", n.alias("deal_point_count"), located.alias("located_count"), summary.alias("summary"))
