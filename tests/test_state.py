"""Merges in place: what is rewritten, which row of a key counts, and what a plain dictionary makes of it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from termlake.operators import ledger, state
from termlake.operators.upsert import guarded_upsert, update_only, upsert_and_prune

OLD, NEW = "id long, part string, value double, updated_at timestamp", "id long, part string, value double, version int"
def stamp():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")



def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(((r.id, r.part, r.value, r.updated_at.year if r.updated_at else None) for r in df.collect()), key=str)


def plain(old, batch, kind, scope):
    """The merge on a dictionary; the last version of a key counts, then the larger row."""
    now = {(i, p): (v, y) for i, p, v, y in old}
    last = {}
    for i, p, v, version in sorted(batch, key=lambda r: (r[3], r[2] is not None, r[2] or 0)):
        last[i, p] = v
    if scope and kind == "upsert":
        now = {k: x for k, x in now.items() if k in last or k[1] != scope}
    for k, v in last.items():
        if k in now and kind != "insert" and now[k][0] != v or k not in now and kind != "update":
            now[k] = v, 2030
    return sorted(((*k, *x) for k, x in now.items()), key=str)


@pytest.mark.parametrize("kind, scope", [("upsert", None), ("upsert", "b"), ("update", None), ("insert", None)])
def test_against_a_dictionary(spark, tmp_path, kind, scope):
    rng = random.Random(7)
    old = [(i, rng.choice("ab"), rng.choice([None, 1.0, 2.0]), 2020) for i in range(200)] + [(None, "a", 5.0, 2020)]
    batch = [(rng.randrange(260), rng.choice("ab"), rng.choice([None, 1.0, 2.0]), rng.randrange(3)) for _ in range(150)] + [(None, "a", 6.0, 1), (None, "a", 7.0, 0)]
    frame = spark.createDataFrame([(i, p, v) for i, p, v, _ in old], "id long, part string, value double").withColumn("updated_at", F.lit("2020-06-01").cast("timestamp"))
    table = state.create(frame, str(tmp_path / "t"), ["id", "part"], 8)
    done = state.merge(table, spark.createDataFrame(batch, NEW), kind, ["version"], None if scope is None else F.col("part") == scope, stamp())
    want = plain(old, batch, kind, scope)
    assert rows_of(table.rows(spark)) == want
    assert done["insert"] == sum(1 for w in want if (w[0], w[1]) not in {(o[0], o[1]) for o in old})
    again = state.merge(table, spark.createDataFrame(batch, NEW), kind, ["version"], None if scope is None else F.col("part") == scope, stamp())
    assert rows_of(table.rows(spark)) == want and again["buckets_written"] == 0 and not again["insert"] + again["update"] + again["delete"]


def test_untouched_files_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(2000).selectExpr("id", "'a' AS part", "cast(id AS double) AS value", "timestamp '2020-01-01' AS updated_at")
    table = state.create(old, path, ["id"], 16)
    before = files(path)
    batch = spark.createDataFrame([(5, "a", 99.0, 1), (6, "a", 6.0, 1)], NEW)  # one changes, one is as it was
    done = state.merge(table, batch, order=["version"], stamp=stamp())
    after = files(path)
    assert (done["update"], done["insert"], done["delete"], done["buckets_written"]) == (1, 0, 0, 1)
    kept = {f for f in before if after.get(f) == before[f]}
    gone = {f.split("_bucket=")[1].split("/")[0] for f in set(before) - kept}
    assert len(gone) == 1 and len({f.split("_bucket=")[1].split("/")[0] for f in before}) == 16
    assert table.rows(spark).where("id = 5").first()["value"] == 99.0 and table.rows(spark).count() == 2000


def test_the_last_row_of_a_bucket_can_go(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, part string, value double").withColumn("updated_at", stamp())
    table = state.create(old, str(tmp_path / "t"), ["id"], 64)
    done = state.merge(table, spark.createDataFrame([(1, "a", 1.0, 1)], NEW), order=["version"], scope=F.col("part") == "b", stamp=stamp())
    assert done["delete"] == 1 and [r.id for r in table.rows(spark).collect()] == [1]
    assert state.merge(table, spark.createDataFrame([], NEW), order=["version"], stamp=stamp())["buckets_read"] == 0


def test_a_table_that_begins_empty(spark, tmp_path):
    table = state.create(spark.createDataFrame([], OLD), str(tmp_path / "t"), ["id"], 4)
    assert table.rows(spark).count() == 0
    assert state.merge(table, spark.createDataFrame([(1, "a", 1.0, 1), (2, "b", None, 1)], NEW), order=["version"], stamp=stamp())["insert"] == 2
    assert rows_of(table.rows(spark)) == [(1, "a", 1.0, 2030), (2, "b", None, 2030)]


def test_one_row_for_each_key_of_a_batch(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "id long, part string, value double").withColumn("updated_at", stamp())
    batch = spark.createDataFrame([(1, "a", 5.0, 1), (1, "a", 4.0, 2), (3, "b", 3.0, 1), (3, "b", 9.0, 1), (None, "c", 1.0, 1), (None, "c", 1.0, 1)], NEW)
    for call in (guarded_upsert, lambda *a, **b: upsert_and_prune(*a[:3], F.col("id") == 2, **b)):
        got = {r.id: r.value for r in call(old, batch, ["id"], stamp=stamp(), order=["version"]).collect()}
        rows = call(old, batch, ["id"], stamp=stamp(), order=["version"]).count()
        assert (got[1], got[3], got[None]) == (4.0, 9.0, 1.0) and rows == len(got)
    assert sorted((r.id, r.value) for r in update_only(old, batch, ["id"], order=["version"]).collect()) == [(1, 4.0), (2, 2.0)]
    assert {r.id: r.value for r in guarded_upsert(old, batch, ["id"], stamp()).collect()}[1] == 5.0  # without an order the larger row


def test_ledger_takes_one_job_and_one_line(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, NULL, id) AS place", "map('k', id) AS m")
    watched, watch = ledger.observed(rows, {"located": F.col("place").isNotNull()})
    spark.sparkContext.setJobGroup("load", "one load")
    watched.write.parquet(str(tmp_path / "rows"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("load")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and watch.get["_n"] == 500 and watch.get["located"] == 333
    path, book = str(tmp_path / "t"), str(tmp_path / "ledger")
    counts = {"located": F.col("place").isNotNull()}
    first = ledger.load(rows, path, "s", book, counts).collect()
    again = ledger.load(rows.repartition(7), path, "s", book, counts).collect()
    assert first == again and len(first) == 1 and first[0].counts == {"located": 333} and first[0].rows_loaded == 500 and first[0].duration_ms > 0 and first[0].started_at
    other = ledger.load(rows.where("id < 499"), path, "s", book, counts, rows_read=500).collect()
    assert other[0].digest != first[0].digest and (other[0].rows_read, other[0].rows_loaded) == (500, 499)
    assert ledger.load(rows.where("false"), path, "empty", book, counts).first()["counts"] == {"located": 0}
    assert ledger.lines(spark, book).count() == 3
