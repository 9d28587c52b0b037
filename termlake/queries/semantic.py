"""Queries of the semantic layer, compiled from selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import size_band
from ..plans.compile import catalog_rows, compile_selection, governed, label_sizes
from ..plans.model import TEST_BANDS, Cubes, Selection
from ..sources import tables as t
from ..sources.tables import sql_with

QUERIES, ORACLES = {}, {}
MATTERS_LABEL = "FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code"
BAND_SQL = "CASE WHEN deal_value IS NULL THEN 'unknown' WHEN deal_value < 100000 THEN 'small' WHEN deal_value < 250000 THEN 'medium' WHEN deal_value < 400000 THEN 'large' ELSE 'largest' END"


def cubes(spark: SparkSession, sf_dir: str) -> Cubes:
    return Cubes(t.deal_points(spark, sf_dir), t.matters(spark, sf_dir), t.concepts(spark, sf_dir))


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


def select(spark, sf_dir, **kw) -> DataFrame:
    return compile_selection(Selection(**kw), cubes(spark, sf_dir))


@register("facet_count", f"SELECT coalesce(c.label, 'unclassified') AS value, count(*) AS n {MATTERS_LABEL} GROUP BY 1", "matters", "concepts")
def facet_count(spark, sf_dir):
    out = select(spark, sf_dir, measures=["matters.n"], dimensions=["concepts.label"])
    return out.select(F.coalesce("concepts__label", F.lit("unclassified")).alias("value"), F.col("matters__n").alias("n"))


@register("rollup_measures", """
SELECT deal_point_name, count(*) AS n, count(*) FILTER (WHERE position NOT IN ('None', 'No', 'N/A')) AS present_count, count(numeric_value) AS numeric_n,
       count(*) FILTER (WHERE NOT is_inferred) AS expert_labelled_n, count(span_start) AS with_source_span_n
FROM deal_points GROUP BY deal_point_name""", "deal_points")
def rollup_measures(spark, sf_dir):
    names = ["n", "present_count", "numeric_n", "expert_labelled_n", "with_source_span_n"]
    out = select(spark, sf_dir, measures=[f"deal_points.{m}" for m in names], dimensions=["deal_points.deal_point_name"])
    return out.toDF("deal_point_name", *names)


@register("distinct_exact", "SELECT position, count(DISTINCT matter_id) AS matters, count(*) AS n FROM deal_points GROUP BY position", "deal_points")
def distinct_exact(spark, sf_dir):
    return select(spark, sf_dir, measures=["deal_points.count_distinct_matters", "deal_points.n"], dimensions=["deal_points.position"]).toDF("position", "matters", "n")


@register("percentiles", """
SELECT deal_point_name, round(quantile_cont(numeric_value, 0.5), 6) AS median, round(quantile_cont(numeric_value, 0.25), 6) AS p25,
       round(quantile_cont(numeric_value, 0.75), 6) AS p75 FROM deal_points GROUP BY deal_point_name""", "deal_points")
def percentiles(spark, sf_dir):
    out = select(spark, sf_dir, measures=[f"deal_points.{p}_numeric_value" for p in ("median", "p25", "p75")], dimensions=["deal_points.deal_point_name"])
    name, *values = out.columns
    return out.select(F.col(name).alias("deal_point_name"), *[F.round(c, 6).alias(a) for c, a in zip(values, ("median", "p25", "p75"))])


@register("mean_vs_median", """
SELECT is_inferred, round(avg(numeric_value), 6) AS mean, round(quantile_cont(numeric_value, 0.5), 6) AS median, count(numeric_value) AS numeric_n
FROM deal_points GROUP BY is_inferred""", "deal_points")
def mean_vs_median(spark, sf_dir):
    # The mean is in the registry and not selectable, so this comparison takes its column by hand.
    from ..plans.model import MEASURES, PREFIX

    facts = t.deal_points(spark, sf_dir)
    prefixed = facts.select(*[F.col(c).alias(PREFIX["deal_points"] + c) for c in facts.columns])
    take = lambda m: MEASURES[f"deal_points.{m}"].column(False)
    return prefixed.groupBy(F.col("dp_is_inferred").alias("is_inferred")).agg(
        F.round(take("mean_numeric_value_do_not_use_for_market"), 6).alias("mean"), F.round(take("median_numeric_value"), 6).alias("median"), take("numeric_n").alias("numeric_n")
    )


@register("vocabulary", "SELECT DISTINCT deal_point_name FROM deal_points", "deal_points")
def vocabulary(spark, sf_dir):
    return select(spark, sf_dir, dimensions=["deal_points.deal_point_name"]).toDF("deal_point_name")


@register("position_distribution", "SELECT deal_point_name, position, count(*) AS n FROM deal_points GROUP BY 1, 2", "deal_points")
def position_distribution(spark, sf_dir):
    return select(spark, sf_dir, measures=["deal_points.n"], dimensions=["deal_points.deal_point_name", "deal_points.position"]).toDF("deal_point_name", "position", "n")


@register("refresh_key", """
SELECT 'deal_points' AS cube, max(updated_at) AS refresh_key FROM deal_points UNION ALL SELECT 'matters', max(updated_at) FROM matters""", "deal_points", "matters")
def refresh_key(spark, sf_dir):
    def newest(name, df):
        return df.agg(F.max("updated_at").alias("refresh_key")).select(F.lit(name).alias("cube"), "refresh_key")

    return newest("deal_points", t.deal_points(spark, sf_dir)).unionByName(newest("matters", t.matters(spark, sf_dir)))


@register("size_band", f"SELECT {BAND_SQL} AS band, count(*) AS n, count(signing_date) AS dated_n FROM matters GROUP BY 1", "matters")
def size_bands(spark, sf_dir):
    return select(spark, sf_dir, measures=["matters.n", "matters.with_signing_date_n"], dimensions=["matters.deal_size_band"]).toDF("band", "n", "dated_n")


@register("attr_lookup", """
SELECT d.position AS consideration_type, count(*) AS n FROM matters m LEFT JOIN deal_points d ON d.matter_id = m.id AND d.deal_point_name = 'DP1' GROUP BY 1""", "matters", "deal_points")
def attr_lookup(spark, sf_dir):
    return select(spark, sf_dir, measures=["matters.n"], dimensions=["matters.consideration_type"]).toDF("consideration_type", "n")


@register("sl_filter_ops", """
SELECT target_name, count(*) AS n FROM matters
WHERE acquirer_name IN ('BUILDING', 'MACHINERY') AND target_name ILIKE '%er#0%' AND deal_value > 100000 AND deal_value < 300000 AND is_inferred_industry
GROUP BY target_name""", "matters")
def sl_filter_ops(spark, sf_dir):
    f = lambda m, o, *v: {"member": f"matters.{m}", "operator": o, "values": list(v)}
    filters = [
        f("acquirer_name", "equals", "BUILDING", "MACHINERY"), f("target_name", "contains", "er#0"), f("deal_value", "gt", "100000"),
        f("deal_value", "lt", "300000"), f("is_inferred_industry", "equals", "true"),
    ]
    return select(spark, sf_dir, measures=["matters.n"], dimensions=["matters.target_name"], filters=filters).toDF("target_name", "n")


@register("sl_having", "SELECT position, count(*) AS n FROM deal_points GROUP BY position HAVING count(*) > 500", "deal_points")
def sl_having(spark, sf_dir):
    having = [{"member": "deal_points.n", "operator": "gt", "values": ["500"]}]
    return select(spark, sf_dir, measures=["deal_points.n"], dimensions=["deal_points.position"], filters=having).toDF("position", "n")


@register("sl_join_filter", """
SELECT c.label, count(*) AS n, count(DISTINCT d.matter_id) AS matters
FROM deal_points d LEFT JOIN matters m ON m.id = d.matter_id LEFT JOIN concepts c ON c.code = m.industry_code
WHERE strftime(m.signing_date, '%Y') = '1997' GROUP BY c.label""", "deal_points", "matters", "concepts")
def sl_join_filter(spark, sf_dir):
    year = [{"member": "matters.signing_year", "operator": "equals", "values": ["1997"]}]
    return select(spark, sf_dir, measures=["deal_points.n", "deal_points.matters_total"], dimensions=["concepts.label"], filters=year).toDF("label", "n", "matters")


@register("sl_fanout_safe", """
SELECT c.label, count(DISTINCT m.id) AS n, count(DISTINCT m.id) FILTER (WHERE m.industry_code IS NOT NULL) AS with_industry_n, count(d.matter_id) AS facts
FROM matters m LEFT JOIN deal_points d ON d.matter_id = m.id LEFT JOIN concepts c ON c.code = m.industry_code GROUP BY c.label""", "matters", "deal_points", "concepts")
def sl_fanout_safe(spark, sf_dir):
    out = select(spark, sf_dir, measures=["matters.n", "matters.with_industry_n", "deal_points.n"], dimensions=["concepts.label"])
    return out.toDF("label", "n", "with_industry_n", "facts")


@register("sl_time_granularity", """
SELECT date_trunc('month', CAST(signing_date AS TIMESTAMP)) AS month, count(*) AS n FROM matters
WHERE signing_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1""", "matters")
def sl_time_granularity(spark, sf_dir):
    times = [{"dimension": "matters.signing_date", "granularity": "month", "date_range": ("1996-01-01", "1997-12-31")}]
    out = select(spark, sf_dir, measures=["matters.n"], time_dimensions=times)
    return out.select(F.col("matters__signing_date__month").cast("timestamp").alias("month"), F.col("matters__n").alias("n"))


@register("sl_min_n_suppress", """
SELECT target_name, count(*) AS n FROM matters GROUP BY target_name HAVING count(*) >= 20 ORDER BY n DESC, target_name LIMIT 100""", "matters")
def sl_min_n_suppress(spark, sf_dir):
    asked = Selection(measures=["matters.n"], dimensions=["matters.target_name"], order={"matters.n": "desc"}, limit=100)
    return governed(asked, cubes(spark, sf_dir), 20).toDF("target_name", "n")


@register("sl_order_limit", "SELECT position, deal_point_name, count(*) AS n FROM deal_points GROUP BY 1, 2 ORDER BY position DESC, deal_point_name LIMIT 25", "deal_points")
def sl_order_limit(spark, sf_dir):
    out = select(spark, sf_dir, measures=["deal_points.n"], dimensions=["deal_points.position", "deal_points.deal_point_name"], order={"deal_points.position": "desc"}, limit=25)
    return out.toDF("position", "deal_point_name", "n")


# The dimensions as SQL over the views; names that are columns stand for themselves.
SIZED = {
    "deal_points": ["matter_id", "deal_point_name", "position", "numeric_value", "is_inferred", "has_source_span", "updated_at"],
    "matters": ["id", "target_name", "acquirer_name", "signing_date", "signing_year", "sic_code", "industry_code", "is_inferred_industry", "has_industry", "deal_value", "deal_size_band",
                "consideration_type", "corpus", "updated_at"],
    "concepts": ["code", "label", "level_1_code", "level_2_code", "level_3_code"],
}
FORMULAS = {
    "has_source_span": "span_start IS NOT NULL", "signing_year": "year(signing_date)", "has_industry": "industry_code IS NOT NULL", "deal_size_band": BAND_SQL,
    "consideration_type": "CASE WHEN id IN (SELECT matter_id FROM answers) THEN (SELECT max(position) FROM answers WHERE matter_id = id) END",
}
SIZES_SQL = ", answers AS (SELECT matter_id, position FROM deal_points WHERE deal_point_name = 'DP1'), sizes AS (" + " UNION ALL ".join(
    f"SELECT '{cube}.{name}' AS name, count(DISTINCT {FORMULAS.get(name, name)}) AS n_values FROM {cube}" for cube, names in SIZED.items() for name in names
) + ")"
VIEWS = ("deal_points", "matters", "concepts")


@register("catalog", SIZES_SQL + " SELECT v.*, coalesce(n_values, 0) AS n_values FROM (VALUES " + ", ".join(f"('{n}', '{k}', '{c}', '{y}', {str(s).lower()})" for n, k, c, y, s in catalog_rows()) + ") v(name, kind, cube, type, selectable) LEFT JOIN sizes ON sizes.name = v.name", *VIEWS)
def catalog(spark, sf_dir):
    """All members, the dimensions with the number of values that the data have."""
    rows = spark.createDataFrame(catalog_rows(), "name string, kind string, cube string, type string, selectable boolean")
    return rows.join(label_sizes(cubes(spark, sf_dir)), "name", "left").na.fill(0, ["n_values"])


def banded(matters: DataFrame) -> DataFrame:
    return matters.withColumn("band", size_band(F.col("deal_value"), TEST_BANDS, "largest"))
