"""The inverted file against every pair: ties, zero vectors, hot lists, blocks, recall."""

import random
import re

import numpy as np
import pytest

from termlake.operators import similar
from termlake.operators.resolve import resolve_values

SCHEMA, ASKED = "code string, embedding array<double>", "raw string, vector array<double>"


def brute(vectors, asked, most=8):
    out = []
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for raw, q in {r: min(v for s, v in asked if s == r) for r, _ in asked}.items():
        best = sorted((-round(float(unit(q) @ unit(v)), 9), c) for c, v in vectors)[:most]
        out += [(raw, c, -s, i) for i, (s, c) in enumerate(best, 1)]
    return sorted(out)


def rows(found):
    return sorted((r.raw, r.code, r.similarity + 0.0, r["rank"]) for r in found.collect())


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    near = lambda c, wide: [x + rng.gauss(0, wide) for x in c]
    vectors = [(f"v{i:04}", near(centers[min(8, i % 13)], 0.3)) for i in range(900)]
    vectors += [(f"same{i:03}", centers[3]) for i in range(300)]  # one list holds many rows, all tied
    vectors += [("zero", [0.0] * 12), ("wide", [1e200] + [0.0] * 11)]
    asked = [(f"q{i}", near(rng.choice(centers), 0.5)) for i in range(40)] + [("tie", centers[3]), ("nothing", [0.0] * 12), ("q0", [9.0] * 12)]
    return vectors, asked


@pytest.mark.parametrize("lists", [None, 1, 400])
def test_exact_search_equals_every_pair(spark, data, lists):
    vectors, asked = data
    vectors = [v for v in vectors if v[0] != "wide"]
    index = similar.build(spark.createDataFrame(vectors, SCHEMA), lists)
    got, want = rows(similar.search(index, spark.createDataFrame(asked, ASKED))), brute(vectors, asked)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-9)


def test_blocks_of_asked_vectors_agree(spark, data, monkeypatch):
    vectors, asked = data
    index, queries = similar.build(spark.createDataFrame(vectors[:500], SCHEMA)), spark.createDataFrame(asked, ASKED)
    whole = rows(similar.search(index, queries))
    monkeypatch.setattr(similar, "BLOCK_BYTES", 12 * 8 * 10)
    assert rows(similar.search(index, queries)) == whole


def test_probes_reach_the_wanted_recall_and_read_less(spark, data):
    vectors, asked = data
    index, queries = similar.build(spark.createDataFrame(vectors, SCHEMA)), spark.createDataFrame(asked[:20], ASKED)
    probes = similar.probes_for(index, queries, 0.95)
    truth = similar.search(index, queries)
    assert probes < len(index.centroids) and similar.recall(similar.search(index, queries, probes=probes), truth) >= 0.95
    one = similar.search(index, queries.limit(1), probes=1)
    lists = {f.split("list=")[1].split("/")[0] for f in index.rows.where("list = 0").inputFiles()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan and len(lists) > 1


def test_rows_that_cannot_be_compared(spark):
    vectors = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", [None, 1.0]), ("g", [float("inf"), 1.0]), ("h", [])]
    index = similar.build(spark.createDataFrame(vectors, SCHEMA))
    asked = [("x", [2.0, 0.1]), ("none", None), ("short", [1.0]), ("nan", [float("nan")] * 2)]
    assert [(r.raw, r.code) for r in similar.search(index, spark.createDataFrame(asked, ASKED)).orderBy("rank").collect()] == [("x", "a"), ("x", "b")]
    empty = similar.build(spark.createDataFrame([], SCHEMA))
    assert similar.search(empty, spark.createDataFrame(asked, ASKED)).count() == 0
    assert similar.search(index, spark.createDataFrame([], ASKED)).count() == 0


def test_ladder_with_candidates(spark):
    concepts = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "code string, label string")
    aliases = spark.createDataFrame([("first", "A"), ("both", "A"), ("both", "B")], "alias string, code string")
    index = similar.build(spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], SCHEMA))
    asked = [(" ALPHA ", None), ("First", [0.0, 1.0]), ("both", None), ("close", [0.1, 1.0]), ("far", [-1.0, -2.0]), ("floor", [0.55, -0.8351646544])]
    got = {r.raw: (r.code, r.method, r.candidates) for r in resolve_values(spark.createDataFrame(asked, ASKED), concepts, aliases, index).collect()}
    assert got == {
        " ALPHA ": ("A", "exact", None), "First": ("A", "alias", None), "both": (None, "refused", None), "close": ("B", "embedding", None),
        "far": (None, "refused", ["A", "B"]), "floor": ("A", "embedding", None),
    }


def test_scores_are_taken_in_small_pieces(spark, data, monkeypatch):
    vectors, asked = data
    vectors = [v for v in vectors if v[0] != "wide"][:400]
    monkeypatch.setattr(similar, "SCORES", 50)
    index = similar.build(spark.createDataFrame(vectors, SCHEMA), 3)
    got = rows(similar.search(index, spark.createDataFrame(asked, ASKED)))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in brute(vectors, asked)]
