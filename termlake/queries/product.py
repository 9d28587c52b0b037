"""Facets, coverage, rollup and drill-through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import render
from ..functions.text import slice_text
from ..operators import coverage as cov
from ..operators import facets as fac
from ..operators.drill import drill_through, matter_cards
from ..operators.gates import confident, refusals
from ..operators.hierarchy import under
from ..operators.retrieval import bm25, summary_line, top_k
from ..operators.rollup import absences, deal_terms, rollup
from ..plans.model import ABSENT_POSITIONS
from ..sources import tables as t
from ..sources.tables import sql_with
from .semantic import BAND_SQL, banded

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


GROUPS = {"industry": "label", "year": "signing_year", "consideration": "consideration_type", "band": "band"}
SELECTED = {"industry": "FRANCE", "year": "1997", "band": "medium"}
BASE_SQL = f""", base AS (
  SELECT m.id, coalesce(c.label, 'unclassified') AS industry, coalesce(strftime(m.signing_date, '%Y'), 'unclassified') AS year,
         coalesce(d.position, 'unclassified') AS consideration, {BAND_SQL} AS band
  FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code LEFT JOIN deal_points d ON d.matter_id = m.id AND d.deal_point_name = 'DP1'
), f AS (
  SELECT 'industry' AS facet, industry AS value, count(*) FILTER (WHERE year = '{{year}}' AND band = '{{band}}') AS n FROM base GROUP BY 1, 2
  UNION ALL SELECT 'year', year, count(*) FILTER (WHERE industry = '{{industry}}' AND band = '{{band}}') FROM base GROUP BY 1, 2
  UNION ALL SELECT 'consideration', consideration, count(*) FILTER (WHERE industry = '{{industry}}' AND year = '{{year}}' AND band = '{{band}}') FROM base GROUP BY 1, 2
  UNION ALL SELECT 'band', band, count(*) FILTER (WHERE industry = '{{industry}}' AND year = '{{year}}') FROM base GROUP BY 1, 2
)
"""
for _k, _v in SELECTED.items():
    BASE_SQL = BASE_SQL.replace("{" + _k + "}", _v)
FACT_VIEWS = ("matters", "concepts", "deal_points")


def facet_base(spark, sf_dir) -> DataFrame:
    answer = t.deal_points(spark, sf_dir).where("deal_point_name = 'DP1'").select(F.col("matter_id").alias("id"), F.col("position").alias("consideration_type"))
    concepts = t.concepts(spark, sf_dir).select(F.col("code").alias("industry_code"), "label")
    matters = banded(t.matters(spark, sf_dir)).join(concepts, "industry_code", "left").join(answer, "id", "left")
    return matters.withColumn("signing_year", F.date_format("signing_date", "yyyy"))


@register("facets_self_excluding", BASE_SQL + "SELECT facet, value, n FROM f", *FACT_VIEWS)
def facets_self_excluding(spark, sf_dir):
    return fac.facets(facet_base(spark, sf_dir), GROUPS, SELECTED).select("facet", "value", "n")


@register("facets_all", BASE_SQL + f"""
SELECT facet, value, n, (facet = 'industry' AND value = '{SELECTED["industry"]}') OR (facet = 'year' AND value = '{SELECTED["year"]}') OR (facet = 'band' AND value = '{SELECTED["band"]}') AS selected,
       CASE WHEN lower(value) IN ('unclassified', 'unknown', 'none') THEN CASE facet WHEN 'industry' THEN 'no industry resolved' WHEN 'year' THEN 'no signing date'
            WHEN 'consideration' THEN 'not recorded' ELSE 'no deal value' END END AS reason
FROM f""", *FACT_VIEWS)
def facets_all(spark, sf_dir):
    return fac.facets(facet_base(spark, sf_dir), GROUPS, SELECTED)


@register("facet_totals", BASE_SQL + """
SELECT facet, CAST(coalesce(sum(n) FILTER (WHERE lower(value) NOT IN ('unclassified', 'unknown', 'none')), 0) AS BIGINT) AS total_n,
       count(*) FILTER (WHERE lower(value) NOT IN ('unclassified', 'unknown', 'none')) AS informative_values, count(*) AS n_values FROM f GROUP BY facet""", *FACT_VIEWS)
def facet_totals(spark, sf_dir):
    return fac.facet_totals(fac.facets(facet_base(spark, sf_dir), GROUPS, SELECTED))


@register("facet_selection_totals", BASE_SQL + f"""
SELECT count(*) FILTER (WHERE industry = '{SELECTED["industry"]}' AND year = '{SELECTED["year"]}' AND band = '{SELECTED["band"]}') AS selected_n, count(*) AS corpus_n FROM base""", *FACT_VIEWS)
def facet_selection_totals(spark, sf_dir):
    return fac.selection_totals(facet_base(spark, sf_dir), GROUPS, SELECTED)


GRID_SQL = f""", counts AS (
  SELECT coalesce(c.label, 'unclassified') AS label, {BAND_SQL} || '/' || coalesce(strftime(m.signing_date, '%Y'), 'unclassified') AS "column", count(*) AS n
  FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code GROUP BY 1, 2
), grid AS (
  SELECT l.label, k."column", coalesce(n.n, 0) AS n FROM (SELECT DISTINCT label FROM counts) l CROSS JOIN (SELECT DISTINCT "column" FROM counts) k
  LEFT JOIN counts n ON n.label = l.label AND n."column" = k."column"
)
"""


def grid(spark, sf_dir) -> DataFrame:
    base = facet_base(spark, sf_dir).withColumn("cell", F.concat_ws("/", "band", F.coalesce("signing_year", F.lit("unclassified"))))
    return cov.coverage_grid(base, "label", "cell")


@register("coverage_grid", GRID_SQL + """
SELECT label, "column", n, n >= 5 AS reportable, CASE WHEN n < 5 THEN 'n=' || n || ': insufficient (threshold 5)' END AS note FROM grid""", "matters", "concepts")
def coverage_grid(spark, sf_dir):
    return grid(spark, sf_dir)


@register("coverage_totals", GRID_SQL + """
SELECT 'row' AS kind, label AS name, CAST(sum(n) AS BIGINT) AS total_n, count(*) FILTER (WHERE n < 5) AS thin_cells, count(*) FILTER (WHERE n = 0) AS empty_cells FROM grid GROUP BY label
UNION ALL SELECT 'column', "column", CAST(sum(n) AS BIGINT), count(*) FILTER (WHERE n < 5), count(*) FILTER (WHERE n = 0) FROM grid GROUP BY "column"
UNION ALL SELECT 'grand', '', CAST(sum(n) AS BIGINT), count(*) FILTER (WHERE n < 5), count(*) FILTER (WHERE n = 0) FROM grid""", "matters", "concepts")
def coverage_totals(spark, sf_dir):
    return cov.coverage_totals(grid(spark, sf_dir))


CHOSEN = "c_mktsegment = 'MACHINERY' AND o_orderstatus = 'P'"  # the selected entities
CHOSEN_SQL = ", chosen AS (SELECT o_orderkey AS matter_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE " + CHOSEN + ")\n"


def chosen(spark, sf_dir) -> DataFrame:
    both = t.load(spark, sf_dir, "orders").join(t.load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.where(CHOSEN).select(F.col("o_orderkey").alias("matter_id"))


def plus_unasked(spark, sf_dir) -> DataFrame:
    """The attribute vocabulary and two names nobody answers."""
    extra = spark.createDataFrame([("DP8",), ("DP9",)], "deal_point_name string")
    return t.deal_points(spark, sf_dir).select("deal_point_name").distinct().unionByName(extra)


VOCABULARY_SQL = "SELECT DISTINCT deal_point_name FROM deal_points UNION ALL SELECT 'DP8' UNION ALL SELECT 'DP9'"


@register("absence_rows", CHOSEN_SQL + f"""
SELECT deal_point_name, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS present_count, 'not answered in this selection' AS reason FROM ({VOCABULARY_SQL}) v
WHERE deal_point_name NOT IN (SELECT deal_point_name FROM deal_points WHERE matter_id IN (SELECT matter_id FROM chosen))""", "deal_points")
def absence_rows(spark, sf_dir):
    return absences(plus_unasked(spark, sf_dir), t.deal_points(spark, sf_dir).join(chosen(spark, sf_dir), "matter_id", "left_semi"))


@register("deal_terms", CHOSEN_SQL + f"""
, r AS (
  SELECT deal_point_name, count(*) AS n, count(*) FILTER (WHERE position NOT IN ('None', 'No', 'N/A')) AS present_count, count(numeric_value) AS numeric_n,
         quantile_cont(numeric_value, 0.5) AS median_value, quantile_cont(numeric_value, 0.25) AS p25_value, quantile_cont(numeric_value, 0.75) AS p75_value, NULL AS reason
  FROM deal_points WHERE matter_id IN (SELECT matter_id FROM chosen) GROUP BY 1
  UNION ALL SELECT deal_point_name, 0, 0, 0, NULL, NULL, NULL, 'not answered in this selection' FROM ({VOCABULARY_SQL}) v
  WHERE deal_point_name NOT IN (SELECT deal_point_name FROM deal_points WHERE matter_id IN (SELECT matter_id FROM chosen))
)
SELECT deal_point_name, n, present_count, numeric_n, median_value, p25_value, p75_value, reason,
       CASE WHEN n = 0 THEN '0 of 100' WHEN n < 10 THEN present_count || ' of ' || n ELSE CAST(CAST(round_even(100.0 * present_count / n, 0) AS INT) AS STRING) || '%' END AS rendered,
       CASE WHEN n < 10 THEN 'count' ELSE 'percentage' END AS kind FROM r""", "deal_points")
def deal_terms_report(spark, sf_dir):
    return deal_terms(t.deal_points(spark, sf_dir), plus_unasked(spark, sf_dir), chosen(spark, sf_dir), 100)


@register("render_counts", """
, c AS (SELECT deal_point_name, coalesce(span_start, -1) AS span_start, count(*) FILTER (WHERE position NOT IN ('None', 'No', 'N/A')) AS present, count(numeric_value) AS answered, count(DISTINCT matter_id) AS selected FROM deal_points GROUP BY 1, 2)
SELECT deal_point_name, span_start, present, answered, selected, CASE WHEN answered = 0 THEN '0 of ' || selected WHEN answered < 8 THEN present || ' of ' || answered
  ELSE CAST(CAST(round_even(100.0 * present / answered, 0) AS INT) AS STRING) || '%' END AS rendered, CASE WHEN answered < 8 THEN 'count' ELSE 'percentage' END AS kind FROM c""", "deal_points")
def render_counts(spark, sf_dir):
    """Counts of each attribute at each place, rendered against those that state a number."""
    present = ~F.col("position").isin(*ABSENT_POSITIONS)
    counts = t.deal_points(spark, sf_dir).groupBy("deal_point_name", F.coalesce("span_start", F.lit(-1)).alias("span_start")).agg(
        F.count_if(present).alias("present"), F.count("numeric_value").alias("answered"), F.count_distinct("matter_id").alias("selected")
    )
    text, kind = render(F.col("present"), F.col("answered"), F.col("selected"), 8)
    return counts.select("*", text.alias("rendered"), kind.alias("kind"))


@register("min_n_gate", """
, s AS (SELECT target_name AS asked, count(DISTINCT id) AS selection_n FROM matters WHERE deal_value IS NOT NULL GROUP BY 1)
SELECT asked, selection_n, selection_n < 5 AS refused, CASE WHEN selection_n < 5 THEN 'n=' || selection_n || ' is below the minimum of 5' END AS reason FROM s""", "matters")
def min_n_gate(spark, sf_dir):
    """The matters of every target as a selection of its own."""
    valued = t.matters(spark, sf_dir).where("deal_value IS NOT NULL").withColumnRenamed("target_name", "asked")
    return refusals(valued, "asked")


CONFIDENCE = [("DP1", 0.95), ("DP2", 0.5), ("DP3", 0.7)]


@register("confidence_gate", f"""
SELECT r.deal_point_name, r.n, c.confidence, coalesce(c.confidence < 0.7, false) AS gated
FROM (SELECT deal_point_name, count(*) AS n FROM deal_points GROUP BY 1) r
LEFT JOIN (SELECT name, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES {", ".join(map(str, CONFIDENCE))}) v(name, confidence)) c ON c.name = r.deal_point_name""", "deal_points")
def confidence_gate(spark, sf_dir):
    confidence = spark.createDataFrame(CONFIDENCE, "deal_point_name string, confidence double")
    return confident(rollup(t.deal_points(spark, sf_dir)), confidence).select("deal_point_name", "n", "confidence", "gated")


@register("drill_through", """
SELECT d.matter_id, m.target_name, m.acquirer_name, d.position, d.numeric_value, d.span_start, d.span_end
FROM deal_points d JOIN matters m ON m.id = d.matter_id WHERE d.deal_point_name = 'DP2' AND d.matter_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)""", "deal_points", "matters")
def drill(spark, sf_dir):
    return drill_through(t.deal_points(spark, sf_dir), t.matters(spark, sf_dir), "DP2", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])


@register("matter_card", """
, k AS (
  SELECT matter_id, count(*) AS deal_point_count, count(span_start) AS located_count, string_agg(deal_point_name || ': ' || position, '; ' ORDER BY deal_point_name) FILTER (WHERE rn <= 5) AS terms
  FROM (SELECT *, row_number() OVER (PARTITION BY matter_id ORDER BY deal_point_name) AS rn FROM deal_points) GROUP BY 1
)
SELECT m.id, coalesce(deal_point_count, 0) AS deal_point_count, coalesce(located_count, 0) AS located_count,
       CASE WHEN acquirer_name IS NOT NULL THEN acquirer_name || ' / ' || target_name ELSE target_name END || ' - ' ||
       CASE WHEN c.label IS NULL THEN 'industry not classified' WHEN is_inferred_industry THEN c.label || ' (inferred)' ELSE c.label END ||
       coalesce(', signed ' || CAST(signing_date AS STRING), '') || '. ' || coalesce('$' || CAST(CAST(round_even(deal_value, 0) AS BIGINT) AS STRING), 'deal value not available') ||
       '. Negotiated terms (n=' || coalesce(deal_point_count, 0) || ', ' || coalesce(located_count, 0) || ' located): ' || coalesce(terms, 'no deal points recorded') || '.' AS summary
FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code LEFT JOIN k ON k.matter_id = m.id""", "matters", "concepts", "deal_points")
def matter_card(spark, sf_dir):
    return matter_cards(t.matters(spark, sf_dir), t.deal_points(spark, sf_dir), t.concepts(spark, sf_dir))


@register("span_slice", """
, s AS (SELECT matter_id, deal_point_name, span_start * 53 AS span_start, span_start * 53 + 40 AS span_end, x.text FROM deal_points d LEFT JOIN documents x ON x.doc_id = d.matter_id % (SELECT count(*) FROM documents)), q AS (
  SELECT *, CASE WHEN span_start IS NULL THEN 'no_span' WHEN text IS NULL THEN 'no_text' WHEN span_end > length(text) THEN 'bad_span' END AS reason FROM s
) SELECT matter_id, deal_point_name, reason, CASE WHEN reason IS NULL THEN substring(text, span_start + 1, 40) END AS clause_text FROM q""", "deal_points")
def span_slice(spark, sf_dir):
    """Spans of 40 characters that begin anywhere in the first ten thousand."""
    texts = t.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    joined = t.deal_points(spark, sf_dir).join(texts, F.col("matter_id") % texts.count() == F.col("key"), "left")
    start = F.col("span_start") * 53
    piece, reason = slice_text(F.col("text"), start, start + 40)
    return joined.select("matter_id", "deal_point_name", reason.alias("reason"), piece.alias("clause_text"))


LINE_SQL = "concat_ws(' · ', m.source_title, nullif(concat_ws(' / ', m.target_name, m.acquirer_name), ''), c.label, strftime(m.signing_date, '%Y'))"


def lined(spark, sf_dir) -> DataFrame:
    concepts = t.concepts(spark, sf_dir).select(F.col("code").alias("industry_code"), "label")
    line = summary_line(F.col("source_title"), F.col("target_name"), F.col("acquirer_name"), F.col("label"), F.col("signing_date"))
    return banded(t.matters(spark, sf_dir)).join(concepts, "industry_code", "left").withColumn("text", line)


@register("summary_line", f"SELECT m.id, {LINE_SQL} AS line FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code", "matters", "concepts")
def summary_lines(spark, sf_dir):
    return lined(spark, sf_dir).select("id", F.col("text").alias("line"))


@register("join_left_label", "SELECT m.id, m.industry_code, c.label FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code", "matters", "concepts")
def join_left_label(spark, sf_dir):
    return lined(spark, sf_dir).select("id", "industry_code", "label")


def optional_filters(df: DataFrame, signed_from=None, signed_to=None, band=None, acquirers=None) -> DataFrame:
    """Only parameters that are set filter; a date range includes both ends."""
    tests = [
        (signed_from, F.col("signing_date") >= F.lit(signed_from).cast("date")), (signed_to, F.col("signing_date") <= F.lit(signed_to).cast("date")),
        (band, F.col("band") == band), (acquirers, F.col("acquirer_name").isin(*(acquirers or [""]))),
    ]
    for value, test in tests:
        if value:
            df = df.where(test)
    return df


@register("filter_optional_params", f"""
SELECT 'dates' AS asked, id FROM matters WHERE signing_date >= DATE '1996-02-01' AND signing_date <= DATE '1996-02-29'
UNION ALL SELECT 'band', id FROM matters WHERE {BAND_SQL} = 'unknown' AND acquirer_name IN ('FURNITURE') UNION ALL SELECT 'none', id FROM matters""", "matters")
def filter_optional_params(spark, sf_dir):
    m = banded(t.matters(spark, sf_dir))
    parts = {
        "dates": optional_filters(m, "1996-02-01", "1996-02-29"), "band": optional_filters(m, band="unknown", acquirers=["FURNITURE"]), "none": optional_filters(m),
    }
    out = [df.select(F.lit(k).alias("asked"), "id") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def bm25_sql(docs: str, query: str) -> str:
    """Common table expressions up to ``scores`` (id, score) over the relation ``docs`` (id, text)."""
    return f""", tok AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {docs}),
 st AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM tok),
 dfs AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(w)) AS term FROM tok) GROUP BY term),
 idf AS (SELECT term, ln(docs - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, st), mi AS (SELECT avg(idf) AS mean_idf FROM idf),
 q AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower('{query}'), '[a-z0-9]+')) AS term) GROUP BY term),
 wt AS (SELECT idf.term, times * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS weight FROM idf JOIN q ON q.term = idf.term, mi),
 tf AS (SELECT id, len(w) AS dl, u.term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM tok) u WHERE u.term IN (SELECT term FROM q) GROUP BY id, dl, u.term),
 sc AS (SELECT id, sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN wt ON wt.term = tf.term, st GROUP BY id),
 scores AS (SELECT tok.id, coalesce(sc.score, 0) AS score FROM tok LEFT JOIN sc ON sc.id = tok.id)"""


ASKED = "machinery customer 1996 france"


@register("comparables", f""", cand AS (
  SELECT m.id, {LINE_SQL} AS text FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code
  WHERE signing_date >= DATE '1996-01-01' AND signing_date <= DATE '1997-12-31' AND (c.level_1_code = 'R3' OR c.code = 'R3')
){bm25_sql("cand", ASKED)}
SELECT id, round(score, 6) AS score, (SELECT count(*) FROM cand) AS candidate_count FROM scores ORDER BY round(score, 6) DESC, id LIMIT 10""", "matters", "concepts")
def comparables(spark, sf_dir):
    inside = under(lined(spark, sf_dir), t.concepts(spark, sf_dir), "R3")
    kept = optional_filters(inside, "1996-01-01", "1997-12-31").select("id", "text")
    scores = bm25(kept, ASKED).withColumn("score", F.round("score", 6))
    return top_k(scores, 10).crossJoin(F.broadcast(kept.agg(F.count("*").alias("candidate_count"))))
