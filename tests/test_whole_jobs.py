"""Queries over whole tables, against SQL of their own without filters, prefixes or samples."""

import duckdb
import pytest

from termlake.queries import QUERIES

from .helpers import docs, saved
from .test_queries import SF, table


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


ALL_CUSTOMERS = """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) - min(o_totalprice) AS wide, min(o_orderkey % 97) AS low, max(o_orderkey % 97) - min(o_orderkey % 97) AS far FROM orders),
s AS (SELECT alpha, o_custkey, o_orderkey, max(o_orderkey) OVER (PARTITION BY alpha, o_custkey) AS last,
        row_number() OVER (PARTITION BY alpha, o_custkey ORDER BY round(alpha * ((o_orderkey % 97)::DOUBLE - low) / far + (1 - alpha) * (o_totalprice - lo) / wide, 9) DESC, o_orderkey) AS rk
      FROM orders, b, (VALUES (0.0::DOUBLE), (0.3), (0.5), (0.7), (1.0)) a(alpha))
SELECT alpha, count(*) AS queries, round(avg((rk <= 1)::INT), 6) AS recall_at_1, round(avg((rk <= 5)::INT), 6) AS recall_at_5, round(avg((rk <= 10)::INT), 6) AS recall_at_10,
       round(avg(CASE WHEN rk <= 10 THEN 1.0 / rk ELSE 0 END), 6) AS mrr FROM s WHERE o_orderkey = last GROUP BY alpha"""


def test_ranks_of_all_customers(spark, engine):
    assert table(QUERIES["eval_recall_mrr"](spark, SF).toPandas()) == table(engine.execute(ALL_CUSTOMERS).df())


ALL_POINTS = """
WITH p AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate),
d AS (SELECT l_orderkey AS id, 'DP' || l_linenumber AS deal_point_name, CASE l_returnflag WHEN 'N' THEN 'None' WHEN 'A' THEN l_quantity::INT || ' business days' ELSE CASE l_linestatus WHEN 'O' THEN 'Greater than 5 business days' ELSE 'All Cash' END END AS predicted,
        l_partkey % 25 > 0 AND l_partkey % 200 % 3 = 0 AS none FROM p)
SELECT id, deal_point_name, predicted, CASE WHEN none THEN 'None' ELSE predicted END AS baseline, none AND predicted <> 'None' AS disagreement FROM d"""


def test_queue_of_all_deal_points(spark, engine):
    assert table(QUERIES["disagreement_queue"](spark, SF).toPandas()) == table(engine.execute(ALL_POINTS).df())


def test_secrets_late_in_a_text_are_redacted(spark, tmp_path):
    late = "some words before " * 50
    texts = [(1, late + "key sk-proj-abcdefghijklmnop1234 and postgres://user:secret@host/db"), (2, late + "Authorization: Bearer abcdefghijklmnop.1234"), (3, None), (4, "")]
    lines = QUERIES["redact"](spark, saved(spark, docs(spark, texts), tmp_path)).collect()
    ends = ["key *** end", "postgres://user:***@host/db", "Authorization: Bearer ***", "nothing here", "sk-short"]
    clean = {1: late + "key *** and postgres://user:***@host/db", 2: late + "Authorization: Bearer ***", 4: ""}
    assert sorted(r.line for r in lines if r.doc_id != 3) == sorted(f"{text} {end}" for text in clean.values() for end in ends)
    assert [r.line for r in lines if r.doc_id == 3] == [None] * 5


def test_short_and_long_quotes(spark, tmp_path):
    long = "a quote of more than twenty-four characters"
    texts = [(1, f"it says short words here, and {long}, then ends"), (2, "ends in short words"), (3, None), (4, ""), (5, "é short words é"), (1, f"it says short words here, and {long}, then ends"), (6, long[:30])]
    quotes = [(1, "short words"), (2, long), (3, "é"), (4, None), (5, ""), (6, long[:24]), (7, "ends"), (7, "ends"), (8, long[:24] + " but not so")]
    saved(spark, docs(spark, texts), tmp_path)
    sf = saved(spark, spark.createDataFrame(quotes, "item_id long, text string"), tmp_path, "benchmark")
    want = sorted((i, k, text.find(q), text.find(q) + len(q)) for i, text in texts for k, q in quotes if text is not None and q is not None and q in text)
    assert sorted(tuple(r) for r in QUERIES["locate_quote"](spark, sf).collect()) == want


def test_excerpts_come_from_all_of_every_document(spark):
    rows = QUERIES["span_locate"](spark, SF).collect()
    lengths = {r.doc_id: len(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(lengths)
    ends = {}
    for r in rows:
        ends.setdefault(r.doc_id, []).append(((r.span_start or 0) / lengths[r.doc_id], (r.span_end or 0) / lengths[r.doc_id]))
    long = [v for k, v in ends.items() if lengths[k] >= 1000]
    assert long and sum(max(b for _, b in v) > 0.95 for v in long) > 0.9 * len(long)
    assert sum(max(a for a, _ in v) > 0.2 for v in long) > 0.5 * len(long)
