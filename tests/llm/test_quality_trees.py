import zlib

import numpy as np
import pyarrow as pa
import pytest

from termlake.llm import quality_trees
from termlake.llm.quality_trees import DEPTH, STATISTICS, Forest, fit, op11_quality_trees, quality_model, scored, statistics

from .helpers import DATA, SF, docs, saved

LABELS = "doc_id long, quality int, toxic int"


def row(text):
    return dict(zip(STATISTICS, statistics(pa.array([text], pa.string()))[0]))


def test_statistics_of_a_text_by_hand():
    x = row("Ab cd!\nAb cd!\nXYZ é# ##")
    assert np.isclose(x["log_chars"], np.log1p(23)) and np.isclose(x["log_words"], np.log1p(7)) and np.isclose(x["log_lines"], np.log1p(3))
    assert np.isclose(x["share_upper"], 5 / 23) and np.isclose(x["share_hash"], 3 / 23) and np.isclose(x["share_beyond"], 1 / 23) and np.isclose(x["share_newline"], 2 / 23)
    assert np.isclose(x["capital_words"], 1 / 7) and np.isclose(x["signed_words"], 4 / 7) and np.isclose(x["sign_only_words"], 1 / 7)
    assert np.isclose(x["distinct_words"], 5 / 7) and np.isclose(x["distinct_lines"], 2 / 3) and x["distinct_shingles"] == 1


@pytest.mark.parametrize("portion", [1, 40, 1 << 21])
def test_statistics_do_not_depend_on_neighbours(monkeypatch, portion):
    texts = ["one two", None, "", "x" * 50_000, "\n\n", "é é é", "one two one two one two one two one two", " \t", "A!B# c\n" * 300]
    alone = np.concatenate([statistics(pa.array([t], pa.string())) for t in texts])
    monkeypatch.setattr(quality_trees, "PORTION", portion)
    together = statistics(pa.array(texts, pa.string()))
    assert np.allclose(alone, together) and np.isfinite(together).all()
    assert np.array_equal(together[1], together[2])  # null is empty


def walked(forest, x):
    """One row down one tree after the other."""
    margin = forest.base
    for column, threshold, leaf in zip(forest.column, forest.threshold, forest.leaf):
        node = 0
        while node < len(column):
            node = 2 * node + 2 if x[column[node]] > threshold[node] else 2 * node + 1
        margin += leaf[node - len(column)]
    return 1 / (1 + np.exp(-margin))


def test_array_traversal_and_training_on_a_known_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6))
    y = ((x[:, 2] > 0.6) ^ (x[:, 4] > 0.3)).astype(float)
    forest = fit(x[:2000], y[:2000])
    scores = forest.scores(x)
    assert np.allclose(scores[:50], [walked(forest, v) for v in x[:50]])
    assert ((scores[2000:] > 0.5) == y[2000:]).mean() > 0.97 and forest.column.shape[1] == (1 << DEPTH) - 1
    assert forest.scores(np.zeros((0, 6))).shape == (0,)


def test_one_kind_of_label_or_none():
    x = np.zeros((3, len(STATISTICS)))
    assert np.allclose(fit(x, np.ones(3)).scores(x), 4 / 5) and np.allclose(fit(x[:0], np.zeros(0)).scores(x), 1 / 2)


def test_edge_rows_and_clashing_names(spark, tmp_path):
    good, bad = "plain words of a quiet sentence go on and on here.", "BUY!! $$$ NOW!! ### "
    rows = [(i, f"{good} number {i}" if i % 2 else bad * (1 + i % 5)) for i in range(300)] + [(900, None), (901, ""), (902, good * 5000), (1, good), (None, good), (None, None)]
    labels = [(i, i % 2, 0) for i in range(300)] + [(2, 1, 0), (4, None, 0), (None, 0, 0), (5000, 0, 0)]
    sf = saved(spark, docs(spark, rows).withColumnRenamed("kept", "_score"), tmp_path)
    saved(spark, spark.createDataFrame(labels, LABELS), tmp_path, "labels")
    found = op11_quality_trees(spark, sf).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and all(r.predicted == r.doc_id % 2 for r in held)
    one = {r.doc_id: r.score for r in found}
    assert one[900] == one[901]
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    out = scored(frame, Forest(0.0, np.zeros((0, 15), np.int64), np.zeros((0, 15)), np.zeros((0, 16))))
    assert out.columns == [*frame.columns, "_score_"]


def test_empty_tables_and_only_text_counts(spark, tmp_path):
    sf = saved(spark, docs(spark, []), tmp_path)
    saved(spark, spark.createDataFrame([], LABELS), tmp_path, "labels")
    assert op11_quality_trees(spark, sf).count() == 0
    frame = docs(spark, [(1, "same words", "en", "a"), (2, "same words", "de", "b"), (3, "other", "fr", "c")])
    model = quality_model(frame, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], LABELS))
    rows = scored(frame, model).collect()
    assert rows[0]["_score"] == rows[1]["_score"]


def test_training_sample_is_bounded(spark):
    frame = docs(spark, [(i % 50, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] * 3, LABELS)
    x, y = quality_trees.training_sample(frame, labels, 30)
    assert x.shape == (30, len(STATISTICS)) and len(y) == 30


def test_held_out_accuracy(spark):
    found = op11_quality_trees(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in found)
    assert len(found) > 50 and right / len(found) > 0.95
    good, bad = ([r.score for r in found if r.quality == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.99


def test_flagship_table(spark):
    assert op11_quality_trees(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
