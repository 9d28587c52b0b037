"""Guarded mutation, first-wins and latest-row rules, and table browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as b
from ..operators import upsert as u
from ..sources import tables as t
from ..sources.readers import first_wins
from ..sources.tables import sql_with

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


# The batch: even orders, some with a changed price, and new ones above all keys.
BATCH_SQL = """
old AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS value, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 2 = 0)"""


def states(spark, sf_dir):
    o = t.load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    value = F.when(key % 7 != 0, F.col("o_totalprice"))
    old = o.where(key % 3 != 0).select(key.alias("id"), F.col("o_orderstatus").alias("status"), value.alias("value"), F.col("o_orderdate").alias("updated_at"))
    new = o.where(key % 2 == 0).select(key.alias("id"), F.col("o_orderstatus").alias("status"), F.when(key % 10 == 0, value + 1).otherwise(value).alias("value"))
    return old, new


STAMP = "2030-01-01 00:00:00"
MERGE_SQL = f"""
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.id IS NULL THEN o.value ELSE n.value END AS value,
       CASE WHEN o.id IS NULL THEN TIMESTAMP '{STAMP}' WHEN n.id IS NULL THEN o.updated_at WHEN (o.status, o.value) IS DISTINCT FROM (n.status, n.value) THEN TIMESTAMP '{STAMP}' ELSE o.updated_at END AS updated_at,
       CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' WHEN (o.status, o.value) IS DISTINCT FROM (n.status, n.value) THEN 'update' ELSE 'keep' END AS change
FROM {{old}} o FULL JOIN new n ON n.id = o.id"""


@register("guarded_upsert", f"WITH {BATCH_SQL} {MERGE_SQL.format(old='old')}")
def guarded_upsert(spark, sf_dir):
    old, new = states(spark, sf_dir)
    return u.guarded_upsert(old, new, ["id"], F.lit(STAMP).cast("timestamp"))


@register("upsert_prune", f"WITH {BATCH_SQL}, kept AS (SELECT * FROM old WHERE NOT (status = 'F' AND id NOT IN (SELECT id FROM new))) {MERGE_SQL.format(old='kept')}")
def upsert_prune(spark, sf_dir):
    old, new = states(spark, sf_dir)
    return u.upsert_and_prune(old, new, ["id"], F.col("status") == "F", F.lit(STAMP).cast("timestamp"))


@register("update_only", f"WITH {BATCH_SQL}, upd AS (SELECT * FROM new WHERE id IN (SELECT id FROM old)) {MERGE_SQL.format(old='old').replace('JOIN new n', 'JOIN upd n')}")
def update_only(spark, sf_dir):
    old, new = states(spark, sf_dir)
    return u.update_only(old, new, ["id"], F.lit(STAMP).cast("timestamp"))


@register("dedupe_first_wins", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_first_wins(spark, sf_dir):
    rows = t.load(spark, sf_dir, "lineitem")
    return first_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@register("latest_per_key", "SELECT event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    e = t.load(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return u.latest_per_key(e, ["event_type"], ["ts", "event_id"])


@register("browse_filter_ilike", "SELECT id, target_name, signing_date FROM matters WHERE CAST(signing_date AS STRING) ILIKE '%-02-1_%'", "matters")
def browse_filter_ilike(spark, sf_dir):
    return b.contains(t.matters(spark, sf_dir), "signing_date", "-02-1_").select("id", "target_name", "signing_date")


@register("browse_sort_page", "SELECT id, deal_value FROM matters ORDER BY deal_value DESC NULLS FIRST, id LIMIT 100 OFFSET 250", "matters")
def browse_sort_page(spark, sf_dir):
    return b.page(t.matters(spark, sf_dir), "id", "deal_value", "desc", 100, 250).select("id", "deal_value")


_PROFILED = ["id", "target_name", "acquirer_name", "industry_code", "is_inferred_industry", "signing_date", "deal_value"]


@register("profile_nulls", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null FROM matters" for c in _PROFILED), "matters")
def profile_nulls(spark, sf_dir):
    return b.profile(t.matters(spark, sf_dir).select(*_PROFILED)).select("column", "n_rows", "n_null")


@register("log_search", """
SELECT event_id AS line_no, level, props, (SELECT count(*) FROM events WHERE event_type = 'click' AND contains(props, '7')) AS total_matched
FROM (SELECT event_id, event_type AS level, props FROM events) WHERE level = 'click' AND contains(props, '7') ORDER BY event_id LIMIT 50 OFFSET 5""")
def log_search(spark, sf_dir):
    lines = t.load(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("level"), "props")
    # The text is looked for in the payload only, as ids hold digits too.
    payload = lines.select("line_no", "level", "props").where(F.contains("props", F.lit("7")))
    return b.log_search(payload, "click", "7", 50, 5)
