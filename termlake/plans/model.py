"""The registry: every measure and dimension once, as column builders over the joined cubes.

A new metric is a new entry here. Aggregates are exact; distinct counts are never approximated.
Columns of a cube carry its prefix (``dp_``, ``m_``, ``c_``) once cubes are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import size_band

ABSENT_POSITIONS = ("None", "No", "N/A")
CONSIDERATION_POINT = "DP1"  # the attribute whose answer is an entity's consideration type
TEST_BANDS = ((100_000.0, "small"), (250_000.0, "medium"), (400_000.0, "large"))


@dataclass(frozen=True)
class Dimension:
    name: str
    cube: str
    type: str  # string, number, boolean or time
    column: Callable[[], Column]
    description: str = ""
    hidden: bool = False


@dataclass(frozen=True)
class Measure:
    """``condition`` picks the rows; ``of`` is what is aggregated, by ``how``; None counts rows."""

    name: str
    cube: str
    how: str
    of: Callable[[], Column] | None = None
    condition: Callable[[], Column] | None = None
    description: str = ""
    selectable: bool = True

    def column(self, fanned_out: bool) -> Column:
        """The aggregate. ``fanned_out`` tells that a 1:N join may repeat the cube's rows, so its keys are counted."""
        test = self.condition() if self.condition else None
        if self.how == "count":
            key = F.col(KEYS[self.cube])
            if fanned_out:
                return F.count_distinct(F.when(test, key) if test is not None else key)
            return F.count(F.when(test, F.lit(1)) if test is not None else F.lit(1))
        value = self.of()
        if self.how == "count_distinct":
            return F.count_distinct(value)
        if self.how == "avg":
            return F.avg(value)
        return F.percentile(value, float(self.how))


KEYS = {"deal_points": "dp_key", "matters": "m_id", "concepts": "c_code"}
PREFIX = {"deal_points": "dp_", "matters": "m_", "concepts": "c_"}


def _c(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _dims(cube: str, entries: list[tuple]) -> list[Dimension]:
    return [Dimension(f"{cube}.{n}", cube, t, col, d, h) for n, t, col, d, h in ((*e, *("", False)[len(e) - 3 :]) for e in entries)]


DIMENSIONS = {
    d.name: d
    for d in [
        *_dims("deal_points", [
            ("id", "string", _c("dp_key"), "Row key", True),
            ("matter_id", "number", _c("dp_matter_id"), "Entity of the fact"),
            ("deal_point_name", "string", _c("dp_deal_point_name"), "Attribute"),
            ("position", "string", _c("dp_position"), "Recorded answer"),
            ("numeric_value", "number", _c("dp_numeric_value"), "Number stated by the answer"),
            ("is_inferred", "boolean", _c("dp_is_inferred"), "Not an expert label"),
            ("has_source_span", "boolean", lambda: F.col("dp_span_start").isNotNull(), "Traced to the text"),
            ("updated_at", "time", _c("dp_updated_at"), "Last real change"),
        ]),
        *_dims("matters", [
            ("id", "number", _c("m_id"), "Entity key"),
            ("target_name", "string", _c("m_target_name")),
            ("acquirer_name", "string", _c("m_acquirer_name")),
            ("signing_date", "time", _c("m_signing_date")),
            ("signing_year", "string", lambda: F.date_format("m_signing_date", "yyyy")),
            ("sic_code", "string", _c("m_sic_code")),
            ("industry_code", "string", _c("m_industry_code")),
            ("is_inferred_industry", "boolean", _c("m_is_inferred_industry")),
            ("has_industry", "boolean", lambda: F.col("m_industry_code").isNotNull()),
            ("deal_value", "number", _c("m_deal_value")),
            ("deal_size_band", "string", lambda: size_band(F.col("m_deal_value"), TEST_BANDS, "largest")),
            ("consideration_type", "string", _c("m_consideration_type"), "Answer to the consideration attribute"),
            ("corpus", "string", _c("m_corpus")),
            ("updated_at", "time", _c("m_updated_at")),
        ]),
        *_dims("concepts", [
            ("code", "string", _c("c_code")),
            ("label", "string", _c("c_label")),
            ("level_1_code", "string", _c("c_level_1_code")),
            ("level_2_code", "string", _c("c_level_2_code")),
            ("level_3_code", "string", _c("c_level_3_code")),
        ]),
    ]
}

_numeric = _c("dp_numeric_value")
MEASURES = {
    m.name: m
    for m in [
        Measure("deal_points.n", "deal_points", "count", description="Facts"),
        Measure("deal_points.present_count", "deal_points", "count", condition=lambda: ~F.col("dp_position").isin(*ABSENT_POSITIONS), description="Facts that state a term"),
        Measure("deal_points.numeric_n", "deal_points", "count", condition=lambda: F.col("dp_numeric_value").isNotNull(), description="Facts with a number"),
        Measure("deal_points.median_numeric_value", "deal_points", "0.5", _numeric, description="Exact median"),
        Measure("deal_points.p25_numeric_value", "deal_points", "0.25", _numeric),
        Measure("deal_points.p75_numeric_value", "deal_points", "0.75", _numeric),
        Measure("deal_points.mean_numeric_value_do_not_use_for_market", "deal_points", "avg", _numeric, description="Skewed; kept for comparison", selectable=False),
        Measure("deal_points.count_distinct_matters", "deal_points", "count_distinct", _c("dp_matter_id"), description="Exact count of entities"),
        Measure("deal_points.matters_total", "deal_points", "count_distinct", _c("dp_matter_id")),
        Measure("deal_points.expert_labelled_n", "deal_points", "count", condition=lambda: ~F.col("dp_is_inferred")),
        Measure("deal_points.with_source_span_n", "deal_points", "count", condition=lambda: F.col("dp_span_start").isNotNull()),
        Measure("matters.n", "matters", "count", description="Entities"),
        Measure("matters.with_industry_n", "matters", "count", condition=lambda: F.col("m_industry_code").isNotNull()),
        Measure("matters.with_signing_date_n", "matters", "count", condition=lambda: F.col("m_signing_date").isNotNull()),
    ]
}

# The roots a question may select from; the rest of the catalogue is listed and not selectable.
SELECTABLE_CUBES = ("deal_points", "matters", "concepts")
OPERATORS = ("equals", "contains", "gt", "lt")
GRANULARITIES = ("day", "month", "year")


@dataclass
class Selection:
    measures: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)  # member, operator, values (strings)
    time_dimensions: list[dict] = field(default_factory=list)  # dimension, granularity, date_range
    order: dict[str, str] = field(default_factory=dict)
    limit: int | None = None


@dataclass(frozen=True)
class Cubes:
    deal_points: DataFrame
    matters: DataFrame
    concepts: DataFrame
