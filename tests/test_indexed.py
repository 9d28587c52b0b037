"""Deep pages, substring search by trigrams, and guarded source texts, each against a plain form."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termlake.operators import browse, pages, trigrams
from termlake.sources import guarded

SCHEMA = "id long, name string, value double"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, rng.choice(["x", "y", None]), rng.choice([None, *map(float, range(30))])) for i in rng.sample(range(5000), 900)], SCHEMA).cache()


@pytest.mark.parametrize("sort", [None, "value", "name"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_equal_a_sort_with_offset(table, sort, direction):
    arranged = pages.arrange(table, "id", sort, direction, 12)
    assert arranged.total == 900 and len(arranged.parts) > 5 or sort == "name"
    for limit, offset in ((10, 0), (50, 395), (500, 300), (20, 890), (20, 899)):
        want = browse.page(table, "id", sort, direction, limit, offset).collect()
        assert pages.page_at(arranged, limit, offset).collect() == want
    assert pages.page_at(arranged, 10, 900).count() == 0 and pages.page_at(arranged, 10, 10**6).count() == 0
    every, seen, last = browse.page(table, "id", sort, direction, 500).collect(), [], None
    while len(seen) < 500:
        step = pages.after(arranged, last["id"], last[sort or "id"], 125).collect() if last else pages.page_at(arranged, 125).collect()
        seen, last = seen + step, step[-1]
    assert seen == every
    assert pages.after(arranged, *[(r["id"], r[sort or "id"]) for r in browse.page(table, "id", sort, direction, 1, 899).collect()][0]).count() == 0


def test_a_deep_page_reads_one_range(spark):
    arranged = pages.arrange(spark.range(200_000).selectExpr("id", "cast(id % 1000 AS double) AS value"), "id", "value", ranges=40)
    page = pages.page_at(arranged, 50, 150_000)
    assert [r.id for r in page.collect()] == sorted(range(750, 200_000, 1000))[:50]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_part", plan)
    with pytest.raises(ValueError):
        pages.page_at(arranged, 0)
    assert pages.arrange(spark.range(0).selectExpr("id", "1.0 AS value"), "id").total == 0


def test_totals_past_the_end(table):
    row = browse.page_of(table, "id", limit=10, offset=5000, always=True).collect()
    assert [tuple(r) for r in row] == [(None, None, None, 900)]
    assert [r.total for r in browse.page_of(table, "id", limit=3).collect()] == [900] * 3
    assert browse.page_of(table, "id", limit=10, offset=5000).count() == 0
    lines = table.select(F.col("id").alias("line_no"), F.col("name").alias("level"))
    assert [tuple(r) for r in browse.log_search(lines, "none such", always=True).collect()] == [(None, None, 0)]


TEXTS = ["The quick brown fox", "THE QUICK", "quic k", "", None, "a%b_c\\d", "ab", "émile É straße", "abcabcabc", "line\nbreak the quick", "漢字仮名交じり文 😀😀x", "o ther"]


@pytest.mark.parametrize("value", ["quick", "THE Q", "q%ck", "qu__k", "", "ab", "abc", "É STRA", "k\nb", "字仮名", "😀x", "the%quick%fox", "a\\%b", "nothing like it", "%", "line_break", "the quick%the"])
def test_trigram_search_equals_contains(spark, value):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "the quick"), (3, "quick again")], "id long, text string")
    index = trigrams.build(df, "id", "text", 8)
    found, want = trigrams.search(df, index, value), browse.contains(df, "text", value)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_trigram_search_reads_its_buckets_only(spark):
    df = spark.createDataFrame([(i, f"text number {i} of many") for i in range(300)], "id long, text string")
    index = trigrams.build(df, "id", "text")
    plan = trigrams.search(df, index, "r 123 o")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert [r.id for r in trigrams.search(df, index, "r 123 o").collect()] == [123]


NAMES = {
    "a/b.txt": "a/b.txt", "./a//b.txt": "a/b.txt", "a/./b.txt": "a/b.txt", "../a/b.txt": None, "a/../../b.txt": None, "a/..": None, "/a/b.txt": None, "a\\b.txt": None, "C:/a.txt": None,
    "file:///a": None, "": None, ".": None, "a/b\0.txt": None, "..a/b..txt": "..a/b..txt", None: None,
}


def test_names_that_leave_the_folder(spark):
    rows = spark.createDataFrame([(k,) for k in NAMES], "name string").select("name", guarded.guarded(F.col("name")).alias("plain")).collect()
    assert {r.name: r.plain for r in rows} == NAMES


def test_spans_come_from_their_chunks(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdé漢 \n", k=20_000))
    sources = guarded.index_texts(spark.createDataFrame([("docs/long.txt", long), ("short", "abc"), ("empty", ""), ("none", None), (None, "x"), ("twice", "b"), ("twice", "a")], "source_file string, text string"))
    asked = [(i, "docs/long.txt", s, s + n) for i, (s, n) in enumerate((rng.randrange(19_000), rng.choice([1, 10, 900])) for _ in range(50))]
    asked += [(100, "docs/long.txt", 0, 20_000), (101, "docs/long.txt", 4095, 4097), (102, "docs/long.txt", 4096, 8192), (103, "docs/long.txt", 19_999, 20_001), (104, "short", 0, 3), (104, "short", 0, 3)]
    asked += [(105, "empty", 0, 1), (106, "none", 0, 1), (107, "missing", 0, 1), (108, "../docs/long.txt", 0, 5), (109, "/etc/passwd", 0, 5), (110, "short", None, 1), (111, "short", -1, 2), (112, "short", 2, 2), (113, None, 0, 1), (None, "twice", 0, 1)]
    rows = guarded.read_spans(sources, spark.createDataFrame(asked, "id long, source_file string, span_start int, span_end int")).collect()
    found = {r.id: (r.clause_text, r.reason) for r in rows}
    assert len(rows) == len(asked)
    for i, name, s, e in asked[:53]:
        assert found[i] == (long[s:e], None)
    reasons = {103: "bad_span", 105: "bad_span", 106: "no_text", 107: "no_text", 108: "outside", 109: "outside", 110: "no_span", 111: "bad_span", 112: "bad_span", 113: "no_text"}
    assert all(found[i] == (None, reason) for i, reason in reasons.items()) and found[104] == ("abc", None) and found[None] == ("a", None)
