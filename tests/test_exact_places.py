"""Excerpts located exactly, samples with ties, pruning with NULL keys, archives and lookups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termlake.operators import browse, evals, retrieval, upsert
from termlake.operators.spans import ANCHORS, locate_spans, locator


def brute(text, excerpt):
    """Character range by trying every place of every anchor in the collapsed text."""
    chars = [(m.start(), m[0]) for m in re.finditer(r"\S|\s+(?=\S)", text.strip())]
    shift = len(text) - len(text.lstrip())
    flat = "".join(" " if c.isspace() else c for _, c in chars)
    at = [i + shift + len(c) - 1 for i, c in chars]
    cursor, ranges = 0, []
    for part in excerpt.split("<omitted>"):
        part = " ".join(re.sub(r"\(Pages?\s*[\d\s,\-–]+\)", " ", part).split())
        if len(part) < 20:
            continue
        got = None
        for k in ANCHORS:
            if k <= len(part):
                heads = [i for i in range(len(flat)) if flat.startswith(part[:k], i)]
                if heads:
                    got = next((i for i in heads if i >= cursor), heads[0])
                    break
        if got is None:
            return None
        end = got + len(part)
        for k in ANCHORS:
            if k <= len(part):
                tails = [i for i in range(got, len(flat)) if flat.startswith(part[-k:], i)]
                if tails:
                    end = tails[0] + k
                    break
        ranges.append((got, end))
        cursor = end
    if not ranges:
        return None
    low, high = min(a for a, _ in ranges), min(max(b for _, b in ranges), len(flat))
    return at[low], at[high - 1] + 1


def test_places_equal_a_search_of_every_place():
    rng = random.Random(6)
    for _ in range(60):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 120))]
        text = "".join(w + rng.choice([" ", "  ", "\n", " \n\t "]) for w in words)
        a, b = sorted(rng.randrange(len(text)) for _ in range(2))
        c = rng.randrange(len(text))
        excerpt = text[a:b] + rng.choice(["", " (Page 3) ", "<omitted>"]) + text[c : c + 40]
        assert locator(text)(excerpt) == brute(text, excerpt), (text, excerpt)
    assert locator("")("x" * 30) is None and locator("some words")("") is None


def test_cut_excerpts_come_back_to_their_characters(spark):
    text = "\n".join(f"Section {i}. The parties agree on item {i * 7} of list {i * i}." for i in range(200))
    cuts = [(k, k * 53 % 9000, 60 + k * 5) for k in range(120)]
    rows = [(k, 1, text[a : a + n].strip()) for k, a, n in cuts]
    texts = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    excerpts = spark.createDataFrame([*rows, (900, 2, "words that are in no text at all"), (901, 1, None)], "id long, doc_id long, excerpt string")
    got = {r.id: (r.span_start, r.span_end) for r in locate_spans(excerpts, texts).collect()}
    assert got[900] == got[901] == (None, None)
    for k, _, cut in rows:
        a, b = got[k]
        assert text[a:b].startswith(cut[:20]) and " ".join(text[a:b].split()).endswith(" ".join(cut.split())[-20:])
    exact = sum(text[got[k][0] : got[k][1]] == cut for k, _, cut in rows)
    assert exact > 0.9 * len(rows)


def test_sample_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None if i < 10 else i % 3, i) for i in range(100)], "v int, id int")
    got = evals.systematic_sample(rows, "v", 10)
    assert got.columns == ["v", "id"]
    found = [(r.v, r.id) for r in got.collect()]
    assert len(found) == len(set(found)) == 10 and [v for v, _ in found].count(None) == 1
    assert sorted(found, key=str) == sorted(((r.v, r.id) for r in evals.systematic_sample(rows.repartition(3), "v", 10).collect()), key=str)


def test_prune_is_null_safe(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (None, "d")], "id int, v string").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    new = spark.createDataFrame([(1, "a")], "id int, v string")
    left = upsert.upsert_and_prune(old, new, ["id"], F.col("v") != "c", F.lit("2021-01-01").cast("timestamp"))
    assert sorted((r.id, r.v) for r in left.collect()) == [(1, "a"), (3, "c")]
    kept = upsert.upsert_and_prune(old.where("v <> 'd'"), spark.createDataFrame([(None, "b")], "id int, v string"), ["id"], F.lit(True), F.lit("2021-01-01").cast("timestamp"))
    assert [(r.id, r.v, r.change) for r in kept.collect()] == [(None, "b", "keep")]


def test_vectors_are_looked_up_or_refused(spark, tmp_path):
    texts = spark.createDataFrame([(1, "alpha"), (2, "beta")], "id int, text string")
    key = retrieval.content_key(F.col("text"))
    first = texts.where("id = 1").select(key.alias("content_key"), F.array(F.lit(1.0)).alias("embedding"))
    second = texts.select(key.alias("content_key"), F.array(F.lit(2.0)).alias("embedding"))
    retrieval.save_vectors(retrieval.merge_archives([first, second]), str(tmp_path / "v"))
    archive = spark.read.parquet(str(tmp_path / "v"))
    assert {r.id: r.embedding for r in retrieval.require_embedded(texts, archive).collect()} == {1: [1.0], 2: [2.0]}
    with pytest.raises(retrieval.MissingVectors, match="1 of 2"):
        retrieval.require_embedded(texts, first)


def test_bounds_of_pages_and_lines(spark):
    rows = spark.range(5)
    with pytest.raises(ValueError):
        browse.log_search(rows, limit=1001, order="id")
    assert [(r.id, r.total) for r in browse.page_of(rows, "id", limit=2, offset=3).collect()] == [(3, 5), (4, 5)]
    assert sorted((r.asked, r.found) for r in browse.lookup(rows, "id", spark.createDataFrame([(4,), (9,), (4,)], "k long")).collect()) == [(4, True), (9, False)]
