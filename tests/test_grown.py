"""Steps that must not grow faster than their input: where rows stay in place, and ways for more than a plan holds."""

import random

from termlake.operators import postings, resolve, spans, trigrams
from termlake.queries import files
from termlake.sources import guarded, readers

NAMES, PAIRS = "id long, names array<string>", "name string, attribute string"


def test_first_resolving_moves_no_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["x"]), (3, None), (4, [None, "a"]), (5, ["c", "b"]), (5, ["a"])], NAMES)
    lookup = spark.createDataFrame([("a", "2"), ("b", "9"), ("b", "1"), ("c", None), (None, "7")], PAIRS)
    want = [(1, "b", "1"), (2, None, None), (3, None, None), (4, "a", "2"), (5, "a", "2"), (5, "b", "1")]
    found = resolve.first_resolving(rows, lookup)
    assert sorted(map(tuple, found.collect())) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert resolve.first_resolving(rows, lookup.where("false")).where("name IS NULL").count() == 6
    monkeypatch.setattr(resolve, "FEW", 0)
    assert sorted(map(tuple, resolve.first_resolving(rows, lookup).collect())) == want


def test_files_without_answers_and_texts_without_an_order(spark, tmp_path):
    """No pass over the files for their schema or their order."""
    (tmp_path / "a.json").write_text('{"version": "1", "data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "t__x", "answers": []}]}]}]}')
    assert readers.nested_qa(spark, str(tmp_path)).count() == 0
    (tmp_path / "texts").mkdir()
    for i in range(3):
        (tmp_path / "texts" / f"f{i}.txt").write_text(f"text {i}")
    found = readers.text_folder(spark, str(tmp_path / "texts"), ordered=False)
    assert sorted(map(tuple, found.collect())) == [(f"f{i}.txt", f"text {i}") for i in range(3)]
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_are_written_by_many_tasks():
    assert [files.parts_for(n) for n in (0, 1, 100, 101, 360_000)] == [1, 1, 1, 2, 3600]


def test_equal_spans_over_the_border_of_two_chunks(spark):
    text = "".join(random.Random(4).choices("abcdef", k=9000))
    sources = guarded.index_texts(spark.createDataFrame([("d", text)], "source_file string, text string"))
    asked = spark.createDataFrame([(1, "d", 4000, 8200), (1, "d", 4000, 8200), (2, "d", 4090, 4100), (2, "d", 4090, 4100)], "id long, source_file string, span_start int, span_end int")
    assert sorted((r.id, r.clause_text) for r in guarded.read_spans(sources, asked).collect()) == [(1, text[4000:8200])] * 2 + [(2, text[4090:4100])] * 2


def test_trigrams_take_a_row_for_each_text_and_bucket(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(20)] + [(20, None), (21, "ab")], "id long, text string")
    index = trigrams.build(df, "id", "text", 4)
    assert index.grams.count() <= 20 * 4
    assert [r.id for r in trigrams.search(df, index, "t 17 T").collect()] == [17]


def test_postings_are_counted_where_their_texts_lie(spark, monkeypatch):
    """No join of all postings with the lengths: the words come behind the join of texts."""
    calls = []
    real = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, *a, **k: (calls.append(self.columns), real(self, *a, **k))[1])
    postings.build(spark.createDataFrame([(1, "a b a"), (1, "c"), (2, None)], "id long, text string"), buckets=2)
    assert calls == [["id", "text"]]


def test_excerpts_are_located_without_whole_frames(spark):
    texts = spark.createDataFrame([(1, "some words stand in this text, which is long enough"), (2, None)], "doc_id long, text string")
    excerpts = spark.createDataFrame([(7, 1, "words stand  in this text"), (8, 2, "words stand in this text"), (9, 1, None)], "id long, doc_id long, excerpt string")
    found = spans.locate_spans(excerpts, texts)
    assert sorted((r.id, r.doc_id, r.span_start, r.span_end) for r in found.collect()) == [(7, 1, 5, 29), (8, 2, None, None), (9, 1, None, None)]
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
