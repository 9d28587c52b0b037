"""Queries that write a table of their own first: states that are merged into, ledgers, arranged pages, indexes of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse, ledger, pages, state, trigrams
from ..sources import guarded
from ..sources import tables as t
from ..sources.shared import shared_path
from ..sources.tables import sql_with
from .mutation import BATCH_SQL, MERGE_SQL, STAMP, states

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


def merged(spark, sf_dir, kind="upsert", scope=None):
    """The old orders after a merge of the batch, which has an outdated row besides each of its rows."""
    old, new = states(spark, sf_dir)
    outdated = new.select("id", F.lit("X").alias("status"), F.lit(-1.0).alias("value"), F.lit(1).alias("version"))
    table = state.create(old, shared_path(spark, "orders-state"), ["id"])
    state.merge(table, new.withColumn("version", F.lit(2)).unionByName(outdated), kind, ["version"], scope, F.lit(STAMP).cast("timestamp"))
    return table.rows(spark).select("id", "status", "value", "updated_at")


MERGED = "SELECT id, status, value, updated_at FROM ({})"


@register("state_merge", f"WITH {BATCH_SQL} " + MERGED.format(MERGE_SQL.format(old="old")))
def state_merge(spark, sf_dir):
    return merged(spark, sf_dir)


@register("state_prune", f"WITH {BATCH_SQL}, kept AS (SELECT * FROM old WHERE NOT (status = 'F' AND id NOT IN (SELECT id FROM new))) " + MERGED.format(MERGE_SQL.format(old="kept")))
def state_prune(spark, sf_dir):
    return merged(spark, sf_dir, scope=F.col("status") == "F")


@register("state_update", f"WITH {BATCH_SQL}, upd AS (SELECT * FROM new WHERE id IN (SELECT id FROM old)) " + MERGED.format(MERGE_SQL.format(old="old").replace("JOIN new n", "JOIN upd n")))
def state_update(spark, sf_dir):
    return merged(spark, sf_dir, "update")


@register("ingest_ledger", """
SELECT 'deal_points' AS source, count(*) AS rows_loaded, count(span_start) AS located, count(numeric_value) AS with_number, 'ok' AS status FROM deal_points""", "deal_points")
def ingest_ledger(spark, sf_dir):
    """The line of a load that is done twice."""
    facts, base = t.deal_points(spark, sf_dir), shared_path(spark, "ledger")
    counts = {"located": F.col("span_start").isNotNull(), "with_number": F.col("numeric_value").isNotNull()}
    for _ in range(2):
        ledger.load(facts, f"{base}/facts", "deal_points", f"{base}/ledger", counts)
    return ledger.lines(spark, f"{base}/ledger").select("source", "rows_loaded", *[F.col("counts")[c].alias(c) for c in counts], "status")


@register("page_deep", "SELECT id, deal_value, (SELECT count(*) FROM matters) AS total FROM matters ORDER BY deal_value DESC NULLS FIRST, id LIMIT 100 OFFSET 1100", "matters")
def page_deep(spark, sf_dir):
    arranged = pages.arrange(t.matters(spark, sf_dir).select("id", "deal_value"), "id", "deal_value", "desc")
    return pages.page_at(arranged, 100, 1100).withColumn("total", F.lit(arranged.total).cast("bigint"))


@register("page_after", """
SELECT id, deal_value FROM matters WHERE deal_value > 30000 OR deal_value = 30000 AND id > 7 OR deal_value IS NULL ORDER BY deal_value NULLS LAST, id LIMIT 100""", "matters")
def page_after(spark, sf_dir):
    arranged = pages.arrange(t.matters(spark, sf_dir).select("id", "deal_value"), "id", "deal_value")
    return pages.after(arranged, 7, 30000.0, 100)


@register("page_past_end", "SELECT 0 AS rows_on_page, count(*) AS total FROM matters WHERE industry_code = 'N3'", "matters")
def page_past_end(spark, sf_dir):
    """The total is there although the page is empty."""
    rows = t.matters(spark, sf_dir).where("industry_code = 'N3'").select("id", "deal_value")
    found = browse.page_of(rows, "id", "deal_value", "asc", 20, 10**7, always=True)
    return found.groupBy("total").agg(F.count("id").alias("rows_on_page")).select("rows_on_page", "total")


PART = "ththe%and_the"


@register("substring_index", f"SELECT doc_id, source FROM documents WHERE text ILIKE '%{PART}%'")
def substring_index(spark, sf_dir):
    d = t.load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return trigrams.search(d, trigrams.build(d, "doc_id", "text"), PART).select("doc_id", "source")


# Names as they might be stored: plain, with empty steps, and three that try to leave the folder.
NAME = """CASE right(deal_point_name, 1) WHEN '1' THEN concat('../docs/', doc, '.txt') WHEN '2' THEN concat('/docs/', doc, '.txt') WHEN '3' THEN concat('docs/../../docs/', doc, '.txt')
  WHEN '4' THEN concat('./docs//', doc, '.txt') ELSE concat('docs/', doc, '.txt') END"""
ASKED = f"""SELECT concat(matter_id, deal_point_name) AS id, {NAME} AS source_file, span_start * 53 AS span_start, span_start * 53 + 60 AS span_end, doc
FROM (SELECT *, matter_id % 1009 AS doc FROM {{facts}}) x"""


@register("guarded_spans", f""", a AS ({ASKED.format(facts="deal_points")}), j AS (
  SELECT a.*, d.text, source_file LIKE '%../%' OR source_file LIKE '/%' AS outside FROM a LEFT JOIN documents d ON d.doc_id = a.doc
), r AS (
  SELECT *, CASE WHEN span_start IS NULL THEN 'no_span' WHEN outside THEN 'outside' WHEN text IS NULL THEN 'no_text' WHEN span_end > length(text) THEN 'bad_span' END AS reason FROM j
) SELECT id, source_file, reason, CASE WHEN reason IS NULL THEN substring(text, span_start + 1, 60) END AS clause_text FROM r""", "deal_points")
def guarded_spans(spark, sf_dir):
    """Spans all over the texts of the documents, which stand for source files; names that leave their folder give no text."""
    d = t.load(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("source_file"), "text")
    asked = spark.sql(ASKED.format(facts="{facts}"), facts=t.deal_points(spark, sf_dir)).drop("doc")
    return guarded.read_spans(guarded.index_texts(d), asked).select("id", "source_file", "reason", "clause_text")
