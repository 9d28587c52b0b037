"""Searches by postings against BM25 over the texts themselves."""

import os
import random
import shutil

import pytest

from termlake.operators import postings
from termlake.operators.retrieval import bm25

SCHEMA = "id long, text string, lang string, source string"


def rounded(scores):
    return sorted((r.id, round(r.score, 9) + 0.0) for r in scores.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(30))) + " Common!", rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None, "en", "a"), (901, "", "en", "b"), (None, "w1 w2", "en", "a")], SCHEMA)


@pytest.fixture(scope="module")
def index(docs):
    return postings.build(docs, strata=("lang", "source"), buckets=16)


QUERIES = ["w1 w7 w50", "common w3 W3, w3", "absent", "", "w0 common absent"]


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("where", [None, "lang = 'en'", "lang = 'en' AND source <> 'b'", "lang = 'xx'"])
def test_equals_bm25_of_the_filtered(docs, index, query, where):
    kept = docs.where("id IS NOT NULL")
    assert rounded(postings.search(index, query, where)) == rounded(bm25(kept.where(where) if where else kept, query))


@pytest.mark.parametrize("query", QUERIES[:2])
def test_any_candidate_set(docs, index, query):
    ids = docs.where("id % 3 = 0").select("id")
    assert rounded(postings.search(index, query, ids=ids)) == rounded(bm25(docs.where("id % 3 = 0"), query))
    assert rounded(postings.search(index, query, "lang = 'de'", ids)) == rounded(bm25(docs.where("id % 3 = 0 AND lang = 'de'"), query))


def test_only_the_buckets_of_the_words_are_read(spark, docs, index, tmp_path):
    """A copy of the index without all other buckets of postings gives the same rows."""
    query = "w1 common w40"
    shutil.copytree(index.path.removeprefix("file://"), tmp_path / "copy")
    wanted = {b for b, _ in postings.asked_words(index, query).values()}
    for folder in os.listdir(tmp_path / "copy/terms"):
        if folder.startswith("bucket=") and int(folder.split("=")[1]) not in wanted:
            shutil.rmtree(tmp_path / "copy/terms" / folder)
    part = postings.Postings(
        str(tmp_path / "copy"), spark.read.schema(index.terms.schema).parquet(str(tmp_path / "copy/terms")), index.lengths, index.frequencies, index.strata, index.buckets
    )
    assert len(wanted) < 16 and rounded(postings.search(part, query, "lang = 'en'")) == rounded(postings.search(index, query, "lang = 'en'"))


def test_repeated_ids_are_one_document(spark):
    frame = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a c", "en", "s"), (2, "b", "en", "s"), (3, "d", "en", "s")], SCHEMA)
    joined = spark.createDataFrame([(1, "a b a c", "en", "s"), (2, "b", "en", "s"), (3, "d", "en", "s")], SCHEMA)
    assert rounded(postings.search(postings.build(frame), "a b")) == rounded(bm25(joined, "a b"))
    assert postings.search(postings.build(frame.where("false")), "a").count() == 0
