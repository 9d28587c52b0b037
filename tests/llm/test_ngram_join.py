import collections
import random

import pytest
from pyspark.sql.functions import lit

from termlake.llm.ngram_join import BANDS, ROWS, THRESHOLD, choose_bands, ngram_join, one_of_each, op5_ngram_join

from .helpers import SF, docs


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=THRESHOLD):
    """{doc_id: (class_id, n_copies, n_links)} by comparing every two texts that share a shingle."""
    copies = collections.defaultdict(list)
    for doc_id, text in rows:
        copies[text or ""].append(doc_id)
    texts = list(copies)
    sets = [shingles(t) for t in texts]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = collections.Counter((a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1 :])
    parent, links = list(range(len(texts))), collections.Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, t in enumerate(texts):
        least[find(i)] += [d for d in copies[t] if d is not None]
    return {d: (min(least[find(i)], default=None), len(copies[t]), links[i]) for i, t in enumerate(texts) for d in copies[t]}


def test_bands():
    assert 1 - (1 - THRESHOLD**ROWS) ** BANDS >= 0.99999
    assert choose_bands(0.5, 0.9, 40)[0] * choose_bands(0.5, 0.9, 40)[1] <= 40


def pairs_near(threshold, n, seed):
    """Pairs of texts whose shingles overlap by the threshold or a little more."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(60, 200)
        words = [f"p{i}w{k}" for k in range(size)]
        shared = next(k for k in range(size) if (k - 4) / (2 * (size - 4) - (k - 4)) >= threshold)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:shared] + [f"p{i}x{k}" for k in range(size - shared)]))]
    return rows


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.8])
def test_recall_at_other_thresholds(spark, threshold):
    rows = pairs_near(threshold, 200, int(100 * threshold))
    want = brute(rows, threshold)
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in ngram_join(docs(spark, rows), threshold).collect()}
    assert all(x[2] == 1 for x in want.values())
    assert sum(got[k] == v for k, v in want.items()) >= 0.99 * len(want)
    assert all(v[2] <= want[k][2] for k, v in got.items())


def test_links_count_once_over_many_bands(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: 60 - i], *(f"y{i}z{k}" for k in range(i))])) for i in range(20)]
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in ngram_join(docs(spark, rows), 0.5).collect()}
    assert choose_bands(0.5)[0] > 32 and got == brute(rows, 0.5)


def test_few_words_in_all(spark):
    got = {r.doc_id: r.class_id for r in ngram_join(docs(spark, [(1, "one"), (2, None)]).coalesce(1)).collect()}
    assert got == {1: 1, 2: 2}


def test_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in op5_ngram_join(spark, SF).collect()}
    assert got == brute(rows)
    assert any(x[2] for x in got.values())


def near_group(n, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        out.append((1000 + i, " ".join(words)))
    return out


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("termlake.llm.ngram_join.BLOCK_ROWS", 16)
    rows = near_group(90)
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in ngram_join(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_large_group_of_unlike_sizes(spark, monkeypatch):
    """Blocks whose least member is unlike many others: parts and extensions of one text beside its near copies."""
    monkeypatch.setattr("termlake.llm.ngram_join.BLOCK_ROWS", 8)
    rows = near_group(60, seed=9)
    base = rows[0][1].split()
    rows += [(2000 + i, " ".join(base[: 100 - i])) for i in range(20)] + [(3000 + i, " ".join(base + [f"y{k}" for k in range(i)])) for i in range(30)]
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in ngram_join(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_names_that_clash(spark):
    frame = docs(spark, EDGE).withColumns({c: lit(5) for c in ("_own", "_key", "_rep", "key", "label", "rep", "h", "text_")})
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [1, 3, 4, 7, 8, 9, 10] and all((r._own, r._key, r._rep, r.label) == (5, 5, 5, 5) for r in rows)


EDGE = [
    (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (6, "one  two"), (7, "a b c d e"),
    (None, "hot text of many copies here"), (8, "hot text of many copies here"), (8, "hot text of many copies here"),
    (9, "z " * 100_000), (10, "z " * 100_000 + "y"),
]


def test_edge_rows_and_columns(spark):
    frame = docs(spark, EDGE)
    got = {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in ngram_join(frame).collect()}
    assert got == {
        (1, 1, 2, 0), (2, 1, 2, 0), (3, 3, 1, 0), (4, 4, 2, 1), (5, 4, 2, 1), (6, 4, 1, 1), (7, 7, 1, 0),
        (None, 8, 3, 0), (8, 8, 3, 0), (9, 9, 1, 0), (10, 10, 1, 0),
    }
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7, 8, 9, 10]


def test_empty_table(spark):
    frame = docs(spark, EDGE).where("false")
    assert ngram_join(frame).count() == 0
    assert one_of_each(frame).count() == 0
