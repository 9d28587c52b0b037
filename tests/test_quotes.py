"""Quotes by fingerprints against a search of every quote in every text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from termlake.operators import quotes as q

TEXT, QUOTE = "doc_id long, text string", "item_id long, quote string"


def brute(texts, quotes):
    return sorted(((i, k, t.find(x), t.find(x) + len(x)) for i, t in texts for k, x in quotes if t is not None and x is not None and x in t), key=str)


def found(spark, texts, quotes):
    return sorted((tuple(r) for r in q.locate_quotes(spark.createDataFrame(texts, TEXT), spark.createDataFrame(quotes, QUOTE)).collect()), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é ñ 漢"])
def test_against_every_place(spark, letters):
    rng = random.Random(len(letters))
    texts = [(i, "".join(rng.choices(letters, k=rng.choice([0, 5, 40, 400, 3000])))) for i in range(60)] + [(70, None), (None, "aba" * 30), (None, "b" * 50), (3, "a" * 100), (3, "a" * 100)]
    whole = [t for _, t in texts if t]
    quotes = []
    for k in range(150):
        t = rng.choice(whole)
        at, size = rng.randrange(len(t)), rng.choice([1, 2, 7, 15, 16, 17, 31, 32, 33, 40, 90, 300])
        x = t[at : at + size]
        quotes.append((k, x if rng.random() < 0.8 else x[:-1] + "z"))
    quotes += [(200, ""), (201, None), (202, "漢" * 11), (5, "a" * 31), (5, "a" * 32), (6, "a" * 32)]
    assert found(spark, texts, quotes) == brute(texts, quotes)


def test_a_crowded_bitmap_and_small_portions(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("abc ", k=500))) for i in range(40)]
    quotes = [(k, texts[k][1][k : k + 10 + 3 * k]) for k in range(40)]
    want = brute(texts, quotes)
    monkeypatch.setattr(q, "PORTION", 100)
    assert found(spark, texts, quotes) == want


def test_every_stretch_has_its_prints_inside_the_text():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdé ", k=5000))
    of = lambda t: set(q.text_prints(pa.array([t]), [], True, None)[1].tolist())
    mine = of(text)
    assert len(mine) < 0.2 * len(text.encode())
    for _ in range(200):
        at, size = rng.randrange(4900), rng.randrange(q.LEAST, 100)
        assert of(text[at : at + size]) <= mine


def test_hashes_of_windows_by_length():
    raw = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabc", np.uint8)
    for size in range(1, 35):
        x = q.window_hashes(raw, size)
        assert len(x) == len(raw) - size + 1 and len(np.unique(x)) == min(3, len(x)) and (x[: len(x) - 3] == x[3:]).all()


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
