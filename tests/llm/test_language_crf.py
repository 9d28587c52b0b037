import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql.functions import lit

from termlake.llm import language_crf
from termlake.llm.language_crf import (
    UND, emissions, features, fit, forward_backward, held_out, label_words, language_model, op1_language_crf, predicted, training_sample,
)
from termlake.llm.text_arrays import utf8

from .helpers import DATA, docs


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 5, 7])
    got, moved = forward_backward(scores.copy(), first, moves)
    expected = np.zeros((3, 3))
    for a, b in zip(first, first[1:]):
        want, total, pairs = np.zeros((b - a, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            p = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
            for x, y in zip(path, path[1:]):
                pairs[x, y] += p
        if b > a:
            assert np.allclose(got[a:b], want / total)
            expected += pairs / total
    assert np.allclose(moved, expected)


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_language_crf(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95


@pytest.fixture(scope="module")
def model(spark):
    return language_model(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))


def test_code_switched_words(spark, model):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("n_chars > 600 AND NOT text RLIKE '[|#$%*&]'").orderBy("doc_id").collect()
    spans = {lang: next(r.text for r in rows if r.lang == lang).split()[:12] for lang in ("en", "de", "es")}
    text = " ".join(w for words in spans.values() for w in words)
    chances, first = label_words(model, pa.array([text]))
    truth = [lang for lang, words in spans.items() for _ in words]
    found = [model.languages[i] for i in chances.argmax(1)]
    assert first.tolist() == [0, 36]
    assert sum(a == b for a, b in zip(truth, found)) >= 32


def test_edge_rows_and_columns(spark, model):
    frame = docs(spark, [(1, None), (2, ""), (3, "123 -- 456"), (4, "the of and the with is"), (4, "the of and the with is"), (None, "der die und nicht " * 60_000), (6, "日本語")])
    rows = predicted(frame, model)
    assert rows.columns == [*frame.columns, "_lang", "_score"]
    got = {r.doc_id: (r._lang, round(r._score, 3)) for r in rows.collect()}
    assert got[1] == got[2] == got[3] == (UND, 0.0)
    assert got[4][0] == "en" and got[None][0] == "de" and got[6][0] in model.languages
    assert rows.count() == 7


def test_nothing_to_learn_from(spark):
    frame = docs(spark, [(1, "some words"), (2, None)])
    assert language_model(frame.where("false")) is None
    assert fit([]) is None
    assert {r._lang for r in predicted(frame, None).collect()} == {UND}
    assert frame.where(held_out(frame.doc_id)).count() <= 2
    assert predicted(frame.where("false"), None).count() == 0


def test_copies_crowd_out_no_language(spark):
    rows = [(i, "der eine text mit sehr vielen kopien", "de") for i in range(100_000)] + [(200_000 + i, f"this is text number {i} of few", "en") for i in range(30)]
    rows += [(300_000 + i, f"und noch ein text {i} ohne kopie", "de") for i in range(50)]
    sample = training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(lang == "en" for _, lang in sample) == 30
    assert sum(lang == "de" for _, lang in sample) == 51
    assert len(set(sample)) == len(sample)


def test_six_hundred_languages(spark):
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rng = np.random.default_rng(5)
    words = {f"l{i:03}": ["".join(rng.choice(syllables, 3)) for _ in range(6)] for i in range(600)}
    rows = [(i * 10 + k, " ".join(rng.choice(words[lang], 8)), lang) for i, lang in enumerate(words) for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_model(frame)
    assert len(model.languages) == 600 and model.weights.size <= language_crf.MOST_WEIGHTS
    asked = spark.createDataFrame([(lang, " ".join(words[lang])) for lang in list(words)[::10]], "truth string, text string")
    got = predicted(asked, model).collect()
    assert len({r._lang for r in got}) > 50
    assert sum(r._lang == r.truth for r in got) / len(got) > 0.9


def test_predictions_equal_the_most_likely_labels(spark, model):
    """The query's language and score against chances summed over all paths of short texts, one text at a time."""
    import itertools

    texts = ["the of", "der und los", "que", "le la x9 mit"]
    got = [(r._lang, r._score) for r in predicted(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), model).collect()]
    k = len(model.languages)
    for text, (lang, score) in zip(texts, got):
        raw, offsets = utf8(pa.array([text]))
        slots, of, first = features(raw, offsets)
        scores = emissions(model.weights, slots, of, int(first[-1]))
        share, total = np.zeros(k), 0.0
        for path in itertools.product(range(k), repeat=len(scores)):
            p = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(model.moves[x, y] for x, y in zip(path, path[1:])))
            total += p
            share += p * np.bincount(path, minlength=k)
        share /= total * len(scores)
        assert lang == model.languages[int(share.argmax())] and abs(score - share.max()) < 1e-4


def test_names_that_clash(spark, model):
    frame = docs(spark, [(1, "the of and the with is"), (2, None)]).withColumns({c: lit(5) for c in ("_lang", "_score", "_letter")})
    for rows in (predicted(frame, model), predicted(frame, None)):
        assert rows.columns == [*frame.columns, "_lang_", "_score_"]
        assert all((r._lang, r._score, r._letter) == (5, 5, 5) for r in rows.collect())


def test_rarer_labels_than_the_model_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(language_crf, "MOST_LANGUAGES", 2)
    words = {"en": "the of and with", "de": "der und nicht mit", "xx": "zzz yyy xxx", "fr": "le la et"}
    counts = {"en": 30, "de": 20, "fr": 5, "xx": 5}
    rows = [(i, f"{words[lang]} {lang}{i} " * 5, lang) for i, lang in enumerate(lang for lang, n in counts.items() for _ in range(n))]
    assert {lang for _, lang in training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))} == {"en", "de"}


def test_the_model_is_bounded():
    for languages in (1, 4, 100, 999, language_crf.MOST_LANGUAGES):
        assert language_crf.slots_for(languages) * languages <= language_crf.MOST_WEIGHTS
