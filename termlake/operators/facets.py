"""Faceted search: each group is counted under every active filter but its own, all groups in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNINFORMATIVE = ("unclassified", "unknown", "none")
REASONS = {"industry": "no industry resolved", "year": "no signing date", "consideration": "not recorded", "band": "no deal value"}


def facets(base: DataFrame, groups: dict[str, str], selected: dict[str, str]) -> DataFrame:
    """facet, value, n, selected and reason. ``groups``: facet to column of ``base``; ``selected``: facet to value.

    A row is exploded into the groups all of whose *other* filters hold for it. Values of the unfiltered data
    that no row keeps come out with n = 0. An empty selected value counts as no filter.
    """
    active = {g: v for g, v in selected.items() if v not in (None, "", 0)}
    value = {g: F.coalesce(F.col(c).cast("string"), F.lit("unclassified")) for g, c in groups.items()}
    holds = {g: F.coalesce(F.col(groups[g]).cast("string") == str(v), F.lit(False)) for g, v in active.items()}

    def others(group: str):
        test = F.lit(True)
        for g, ok in holds.items():
            if g != group:
                test = test & ok
        return test

    cells = F.array(*[F.struct(F.lit(g).alias("facet"), v.alias("value"), others(g).alias("kept")) for g, v in value.items()])
    counted = base.select(F.explode(cells).alias("x")).groupBy("x.facet", "x.value").agg(F.count_if("x.kept").alias("n"))
    chosen = F.lit(False)
    for g, v in active.items():
        chosen = chosen | ((F.col("facet") == g) & (F.col("value") == str(v)))
    reason = F.lit(None).cast("string")
    for g, text in REASONS.items():
        reason = F.when((F.col("facet") == g) & F.lower("value").isin(*UNINFORMATIVE), text).otherwise(reason)
    return counted.select("facet", "value", "n", chosen.alias("selected"), reason.alias("reason"))


def facet_totals(counted: DataFrame) -> DataFrame:
    """Per facet the entities with an informative value, and how many values there are."""
    informative = ~F.lower("value").isin(*UNINFORMATIVE)
    return counted.groupBy("facet").agg(
        F.coalesce(F.sum(F.when(informative, F.col("n"))), F.lit(0)).cast("bigint").alias("total_n"), F.count_if(informative).alias("informative_values"), F.count("*").alias("n_values")
    )


def selection_totals(base: DataFrame, groups: dict[str, str], selected: dict[str, str]) -> DataFrame:
    """Entities under all filters, and of the whole corpus."""
    test = F.lit(True)
    for g, v in selected.items():
        if v not in (None, "", 0):
            test = test & F.coalesce(F.col(groups[g]).cast("string") == str(v), F.lit(False))
    return base.agg(F.count_if(test).alias("selected_n"), F.count("*").alias("corpus_n"))
