"""Evaluation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import wilson
from ..functions.text import keyword_class, keywords
from ..operators import evals as e
from ..operators.retrieval import hybrid
from ..sources import tables as t
from ..sources.tables import sql_with

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


LOW = "greatest(0.0, (p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))"
HIGH = "least(1.0, (p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))"


@register("wilson", f"""
SELECT c_nationkey, n, correct, round({LOW}, 6) AS ci_low, round({HIGH}, 6) AS ci_high
FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS correct, 1.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*) AS p FROM customer GROUP BY 1)""")
def wilson_by_nation(spark, sf_dir):
    counted = t.load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return counted.select("c_nationkey", "n", "correct", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


WORDS = "stount shanen"
HIT = "contains(lower(text), 'stount') OR contains(lower(text), 'shanen')"


@register("eval_calibration", f"""
SELECT source, n, correct, round(p, 3) AS accuracy, round({LOW}, 3) AS ci_low, round({HIGH}, 3) AS ci_high, {LOW} >= 0.7 AS reportable
FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE predicted = quality) AS correct, 1.0 * count(*) FILTER (WHERE predicted = quality) / count(*) AS p
      FROM (SELECT d.source, CASE WHEN {HIT} THEN 1 ELSE 0 END AS predicted, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY source)""")
def eval_calibration(spark, sf_dir):
    said = keyword_class(keywords(F.lit(WORDS)), F.col("text"), F.array(F.lit("no"), F.lit("yes")))
    predictions = t.load(spark, sf_dir, "documents").select("doc_id", "source", (said == "yes").cast("int").alias("predicted"))
    truth = t.load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual"))
    return e.calibration(predictions, truth, ["doc_id"], "source")


# Per customer the priorities of its orders against those of its finished ones: the sets to compare.
SETS_SQL = """
WITH s AS (SELECT c_custkey AS id, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS expected, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS actual
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), k AS (SELECT *, len(list_intersect(expected, actual)) AS common FROM s)"""


def sets(spark, sf_dir):
    c, o = t.load(spark, sf_dir, "customer"), t.load(spark, sf_dir, "orders")
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("id")).agg(of("F").alias("expected"), of("O").alias("actual"))


@register("eval_prf", SETS_SQL + """
SELECT round(avg(CASE WHEN len(expected) = 0 AND len(actual) = 0 THEN 1.0 WHEN len(expected) = 0 OR len(actual) = 0 THEN 0.0 ELSE 1.0 * common / len(actual) END), 3) AS precision,
       round(avg(CASE WHEN len(expected) = 0 AND len(actual) = 0 THEN 1.0 WHEN len(expected) = 0 OR len(actual) = 0 THEN 0.0 ELSE 1.0 * common / len(expected) END), 3) AS recall, count(*) AS cases FROM k""")
def eval_prf(spark, sf_dir):
    p, r = e.precision_recall(F.col("expected"), F.col("actual"))
    return sets(spark, sf_dir).agg(F.round(F.avg(p), 3).alias("precision"), F.round(F.avg(r), 3).alias("recall"), F.count("*").alias("cases"))


@register("eval_exact_set", SETS_SQL + " SELECT id, common = len(expected) AND common = len(actual) AS same FROM k")
def eval_exact_set(spark, sf_dir):
    return sets(spark, sf_dir).select("id", e.same_set(F.col("expected"), F.col("actual")).alias("same"))


# Known items by customer segment: score of an order is its price, of two kinds, blended; the relevant one is the customer's last order.
RANK_SQL = """
WITH o AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS lex, CAST(o_orderkey % 97 AS DOUBLE) AS sem, o_orderdate FROM orders),
rel AS (SELECT query_id, max(id) AS id FROM o GROUP BY 1), g AS (SELECT o.query_id, o.id, a.alpha, round(a.alpha * (sem - (SELECT min(sem) FROM o)) / (SELECT max(sem) - min(sem) FROM o)
  + (1 - a.alpha) * (lex - (SELECT min(lex) FROM o)) / (SELECT max(lex) - min(lex) FROM o), 9) AS score FROM o, (VALUES (0.0), (0.3), (0.5), (0.7), (1.0)) a(alpha)),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, id) AS rk FROM g),
h AS (SELECT r.alpha, r.query_id, CASE WHEN r.rk <= 10 THEN r.rk END AS rk FROM r JOIN rel ON rel.query_id = r.query_id AND rel.id = r.id)
SELECT CAST(alpha AS DOUBLE) AS alpha, count(*) AS queries, round(avg(CASE WHEN rk <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5,
       round(avg(CASE WHEN rk <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / rk, 0)), 6) AS mrr FROM h GROUP BY alpha"""


RANKS = RANK_SQL[: RANK_SQL.index("SELECT CAST(alpha")]


def ranked_orders(spark, sf_dir, alphas):
    """Blended scores of all orders, the customer who asks for each, and the order that is the relevant one."""
    o = t.load(spark, sf_dir, "orders")
    lexical = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    semantic = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).cast("double").alias("score"))
    blended = hybrid(lexical, semantic, alphas).withColumn("score", F.round("score", 9))
    asked = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"))
    return blended, asked, asked.groupBy("query_id").agg(F.max("id").alias("id"))


@register("eval_recall_mrr", RANK_SQL)
def eval_recall_mrr(spark, sf_dir):
    blended, asked, relevant = ranked_orders(spark, sf_dir, (0.0, 0.3, 0.5, 0.7, 1.0))
    return e.ranked_metrics(blended.join(asked, "id"), relevant, ["alpha"])


@register("systematic_sample", """
, k AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, greatest(1, count(*) OVER () // 30) AS step FROM matters)
SELECT id FROM k WHERE (rn - 1) % step = 0 AND rn <= step * 30""", "matters")
def systematic_sample(spark, sf_dir):
    return e.systematic_sample(t.matters(spark, sf_dir), "id").select("id")


@register("holdout_by_hash", "SELECT id FROM matters ORDER BY sha256(CAST(id AS STRING)) LIMIT 20", "matters")
def holdout_by_hash(spark, sf_dir):
    return e.holdout_by_hash(t.matters(spark, sf_dir), "id").select("id")


@register("disagreement_queue", """
SELECT matter_id AS id, deal_point_name, position AS predicted, CASE WHEN span_start % 3 = 0 THEN 'None' ELSE position END AS baseline, CASE WHEN span_start % 3 = 0 THEN position <> 'None' ELSE false END AS disagreement
FROM deal_points""", "deal_points")
def disagreement_queue(spark, sf_dir):
    d = t.deal_points(spark, sf_dir)
    baseline = F.when(F.col("span_start") % 3 == 0, "None").otherwise(F.col("position"))
    return e.disagreement_queue(d.select(F.col("matter_id").alias("id"), "deal_point_name", F.col("position").alias("predicted"), baseline.alias("baseline")))


@register("query_templates", """
, k AS (SELECT m.id, target_name, acquirer_name, c.label, strftime(signing_date, '%Y') AS y FROM matters m JOIN concepts c ON c.code = m.industry_code WHERE acquirer_name IS NOT NULL AND signing_date IS NOT NULL)
SELECT id, 'parties' AS template, target_name || ' ' || acquirer_name AS query FROM k UNION ALL SELECT id, 'target_year', target_name || ' ' || y FROM k UNION ALL SELECT id, 'industry_year', label || ' ' || y FROM k""", "matters", "concepts")
def query_templates(spark, sf_dir):
    concepts = t.concepts(spark, sf_dir).select(F.col("code").alias("industry_code"), "label")
    return e.query_templates(t.matters(spark, sf_dir).join(concepts, "industry_code", "left"))
