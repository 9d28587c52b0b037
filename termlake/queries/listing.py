"""Listings, lookups and small text functions over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import header_date, truncate
from ..operators import browse as b
from ..operators import evals as e
from ..operators import retrieval as r
from ..operators import upsert as u
from ..operators.facets import facets
from ..plans.compile import described_rows, label_sizes
from ..sources import tables as t
from ..sources.readers import titles
from ..sources.tables import sql_with
from .evaluation import RANKS, ranked_orders
from .product import LINE_SQL, lined
from .semantic import SIZES_SQL, VIEWS, cubes

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


@register("browse_page_total", """
SELECT id, deal_value, (SELECT count(*) FROM matters WHERE industry_code = 'N3') AS total FROM matters WHERE industry_code = 'N3' ORDER BY deal_value NULLS LAST, id LIMIT 20 OFFSET 40""", "matters")
def browse_page_total(spark, sf_dir):
    rows = t.matters(spark, sf_dir).where("industry_code = 'N3'")
    return b.page_of(rows, "id", "deal_value", "asc", 20, 40).select("id", "deal_value", "total")


@register("point_lookup", """
, a AS (SELECT DISTINCT o_custkey * 3 AS asked FROM orders) SELECT asked, m.id IS NOT NULL AS found, m.id, m.target_name FROM a LEFT JOIN matters m ON m.id = asked""", "matters")
def point_lookup(spark, sf_dir):
    asked = t.load(spark, sf_dir, "orders").select(F.col("o_custkey") * 3)
    return b.lookup(t.matters(spark, sf_dir), "id", asked).select("asked", "found", "id", "target_name")


@register("temporal_text", "SELECT id, strftime(signing_date, '%Y-%m-%d') AS signing_date, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM matters", "matters")
def temporal_text(spark, sf_dir):
    return b.iso_text(t.matters(spark, sf_dir).select("id", "signing_date", "updated_at"))


@register("comparables_unranked", f", cand AS (SELECT m.id, {LINE_SQL} AS text FROM matters m LEFT JOIN concepts c ON c.code = m.industry_code WHERE m.industry_code = 'N7') SELECT id, text FROM cand ORDER BY id LIMIT 25", "matters", "concepts")
def comparables_unranked(spark, sf_dir):
    return r.unranked(lined(spark, sf_dir).where("industry_code = 'N7'").select("id", "text"), 25)


CLAUSE_CHARS = 2000  # of a clause so much is embedded


@register("texts_to_embed", f"""
SELECT text, count(*) AS n_sources FROM (SELECT text FROM documents WHERE text <> '' UNION ALL SELECT left(text, {CLAUSE_CHARS}) FROM benchmark WHERE text <> '') GROUP BY text""")
def texts_to_embed(spark, sf_dir):
    sources = [t.load(spark, sf_dir, name) for name in ("documents", "benchmark")]
    return r.to_embed(sources, [None, CLAUSE_CHARS]).select("text", "n_sources")


@register("embedding_lookup", """
SELECT d.doc_id, v.vec_id IS NULL AS missing FROM documents d LEFT JOIN (SELECT e.vec_id, x.text FROM embeddings e JOIN documents x ON x.doc_id = e.vec_id) v ON v.text = d.text AND v.vec_id = (SELECT min(y.doc_id) FROM documents y JOIN embeddings z ON z.vec_id = y.doc_id WHERE y.text = d.text)""")
def embedding_lookup(spark, sf_dir):
    """Vectors archived under the content of the documents with their number; two archives, the earlier one first."""
    d = t.load(spark, sf_dir, "documents").select("doc_id", "text")
    v = t.load(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(d, F.col("vec_id") == F.col("doc_id"))
    keyed = v.select(r.content_key(F.col("text")).alias("content_key"), "embedding", "vec_id")
    archive = r.merge_archives([keyed.where("vec_id % 2 = 0"), keyed.where("vec_id % 2 = 1")])
    return r.embedded(d, archive).select("doc_id", "missing")


@register("allowed_answers", "SELECT deal_point_name, string_agg(DISTINCT position, '|' ORDER BY position) AS answers, count(DISTINCT position) AS n_answers FROM deal_points GROUP BY 1", "deal_points")
def allowed_answers(spark, sf_dir):
    found = e.allowed_answers(t.deal_points(spark, sf_dir))
    return found.select("deal_point_name", F.array_join("answers", "|").alias("answers"), F.size("answers").cast("bigint").alias("n_answers"))


@register("label_counts", "SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_counts(spark, sf_dir):
    return t.load(spark, sf_dir, "labels").groupBy(F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic")).agg(F.count("*").alias("n"))


@register("ingest_statistics", "SELECT count(*) AS n, count(span_start) AS located, count(*) - count(span_start) AS unlocated, count(numeric_value) AS with_number, count(DISTINCT deal_point_name) AS names, count(DISTINCT matter_id) AS entities FROM deal_points", "deal_points")
def ingest_statistics(spark, sf_dir):
    return e.ingest_statistics(t.deal_points(spark, sf_dir))


DESCRIBED = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in row)) for row in described_rows())


@register("catalog_descriptions", SIZES_SQL + f" SELECT v.*, coalesce(n_values, 0) AS n_values FROM (VALUES {DESCRIBED}) v(name, kind, description) LEFT JOIN sizes ON sizes.name = v.name", *VIEWS)
def catalog_descriptions(spark, sf_dir):
    rows = spark.createDataFrame(described_rows(), "name string, kind string, description string")
    return rows.join(label_sizes(cubes(spark, sf_dir)), "name", "left").na.fill(0, ["n_values"])


@register("id_suffix", "SELECT page_id, list_last(string_split('page__' || url, '__')) AS suffix FROM pages")
def id_suffix(spark, sf_dir):
    pages = t.load(spark, sf_dir, "pages")
    return pages.select("page_id", F.substring_index(F.concat(F.lit("page__"), "url"), "__", -1).alias("suffix"))


@register("truncated_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…[+' || (length(text) - 200) || ' chars]' ELSE text END AS logged FROM documents")
def truncated_text(spark, sf_dir):
    return t.load(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text")).alias("logged"))


@register("stated_dates", "SELECT id, signing_date AS stated FROM matters", "matters")
def stated_dates(spark, sf_dir):
    """Dates written out in upper case and read again."""
    written = F.concat(F.lit("AGREEMENT dated as of "), F.upper(F.date_format("signing_date", "MMMM d, yyyy")), F.lit(" by A"))
    return t.matters(spark, sf_dir).select("id", header_date(written).alias("stated"))


@register("text_titles", r"SELECT doc_id, coalesce(nullif(trim(left(trim(regexp_replace(left(text, 600), '\s+', ' ', 'g')), 200)), ''), 'untitled') AS title FROM documents")
def text_titles(spark, sf_dir):
    return titles(t.load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "title")


@register("bucket_labels", """
SELECT 'year' AS facet, coalesce(CAST(year(signing_date) AS STRING), 'unclassified') AS value, count(*) AS n, CASE WHEN year(signing_date) IS NULL THEN 'no signing date' END AS reason FROM matters GROUP BY year(signing_date)
UNION ALL SELECT 'industry', coalesce(industry_code, 'unclassified'), count(*), CASE WHEN industry_code IS NULL THEN 'no industry resolved' END FROM matters GROUP BY industry_code""", "matters")
def bucket_labels(spark, sf_dir):
    rows = t.matters(spark, sf_dir).withColumn("year", F.year("signing_date"))
    return facets(rows, {"year": "year", "industry": "industry_code"}, {}).select("facet", "value", "n", "reason")


@register("saturated_templates", RANKS + """, n AS (SELECT query_id, CAST(least(count(*), 12) AS INT) AS template FROM o GROUP BY 1),
m AS (SELECT template, alpha, avg(CASE WHEN rk <= 1 THEN 1.0 ELSE 0.0 END) AS recall FROM h JOIN n ON n.query_id = h.query_id WHERE alpha IN (0.0, 1.0) GROUP BY 1, 2)
SELECT template, min(recall) >= 0.999 AS saturated FROM m GROUP BY 1""")
def saturated_templates(spark, sf_dir):
    """Customers by their number of orders: whether both pure methods find the last order first."""
    blended, asked, relevant = ranked_orders(spark, sf_dir, (0.0, 1.0))
    templates = asked.groupBy("query_id").agg(F.least(F.count("*"), F.lit(12)).cast("int").alias("template"))
    return e.saturated(e.ranked_metrics(blended.join(asked, "id").join(templates, "query_id"), relevant, ["template", "alpha"]), "template")


@register("insert_ignore", """
SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT o_custkey, min('new ' || o_custkey) FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey""")
def insert_ignore(spark, sf_dir):
    """The batch has every ordering customer many times; two thirds of all customers are known."""
    old = t.load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = t.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("new "), F.col("o_custkey")).alias("name"))
    return u.insert_ignore(old, new, ["id"])


@register("parents_first", "SELECT code, parent_code, level FROM concepts ORDER BY level, code", "concepts")
def parents_first(spark, sf_dir):
    return t.concepts(spark, sf_dir).select("code", "parent_code", "level").orderBy("level", "code")
