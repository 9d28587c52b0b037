import collections
import itertools
import math
import zlib

import numpy as np
from pyspark.sql.functions import lit

from termlake.llm import sharding
from termlake.llm.sharding import SHARDS, op7_sharding, shuffle_to_shards

from .helpers import SF, docs


def gapless(rows, shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r[-2]].append(r[-1])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    return slots


def matrix(counts, sizes, seed):
    rows = dict(sharding.matrix_rows(np.array(counts), np.array(sizes), seed, 0, len(counts)))
    return np.array([rows[p] for p in range(len(counts))])


def test_matrix_sums():
    counts, sizes = [5, 0, 11, 40], [14, 14, 14, 14]
    m = matrix(counts, sizes, 1)
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and m.min() >= 0
    for p in range(4):  # each task draws the same row by itself
        assert [(q, r.tolist()) for q, r in sharding.matrix_rows(np.array(counts), np.array(sizes), 1, p, p + 1)] == [(p, m[p].tolist())]


def test_matrix_law():
    """Entries against the law of a uniform permutation: counts of two partitions' rows in shard 0, by enumeration."""
    counts, sizes, draws = [2, 1, 2], [3, 2], 4000
    owner = [0, 0, 1, 2, 2]
    want = collections.Counter()
    for chosen in itertools.combinations(range(5), 3):
        want[tuple(sum(owner[i] == p for i in chosen) for p in range(3))] += 1
    got = collections.Counter(tuple(matrix(counts, sizes, seed)[:, 0]) for seed in range(draws))
    assert set(got) == set(want)
    chi = sum((got[k] - draws * n / 10) ** 2 / (draws * n / 10) for k, n in want.items())
    assert chi < len(want) - 1 + 5 * (2 * len(want)) ** 0.5


def exact(good, bad, sample, k):
    log = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return math.exp(log(good, k) + log(bad, sample - k) - log(good + bad, sample))


def falling(good, bad, sample, k):
    """P(k) for a small sample from many rows, by products."""
    p = math.comb(sample, k)
    for i in range(k):
        p *= (good - i) / (good + bad - i)
    for i in range(sample - k):
        p *= (bad - i) / (good + bad - k - i)
    return p


def test_counts_beyond_a_billion_have_the_exact_law():
    rng, draws = np.random.default_rng(8), 40_000
    for good, bad, sample in ((2 * 10**9, 6 * 10**9, 12), (20_000, 2 * 10**9, 10_000), (3 * 10**9, 10**9, 5), (10**12, 10**13, 9)):
        got = collections.Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(draws))
        chi = cells = tail = seen = 0
        for k in range(min(good, sample) + 1):
            p = falling(good, bad, sample, k) if sample < 100 else exact(sample, good + bad - sample, good, k)
            if p * draws < 10:
                tail, seen = tail + p, seen + got[k]
                if k > 60:
                    break
                continue
            chi, cells = chi + (got[k] - p * draws) ** 2 / (p * draws), cells + 1
        assert cells > 1 and chi < cells + 5 * (2 * cells) ** 0.5, (good, bad, sample, chi, cells)
    assert sum(got.values()) == draws
    wide = np.array([sharding.hypergeometric(rng, 10**10, 10**10, 10**8) for _ in range(300)])
    assert abs(wide.mean() - 5 * 10**7) < 5 * 5000 / 300**0.5 and 4000 < wide.std() < 6000


def test_numbers_of_both_ways_agree(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 1)
    rng = np.random.default_rng(3)
    got = collections.Counter(sharding.hypergeometric(rng, 7, 9, 6) for _ in range(20_000))
    for k in range(7):
        p = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert abs(got[k] - 20_000 * p) < 5 * (20_000 * p) ** 0.5 + 1
    assert matrix([30, 12, 8], [20, 20, 10], 2).sum(1).tolist() == [30, 12, 8]


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    frame = docs(spark, [(i, f"t{i}") for i in range(500)]).repartition(6)
    rows = shuffle_to_shards(frame, 3).collect()
    gapless(rows, 3)
    assert sorted(r.doc_id for r in rows) == list(range(500))


def test_names_that_clash(spark):
    frame = docs(spark, [(i, "t") for i in range(20)]).withColumns({c: lit(5) for c in ("_shard", "_slot", "_cell", "_draw")})
    out = shuffle_to_shards(frame, 2)
    assert out.columns == [*frame.columns, "_shard_", "_slot_"]
    rows = out.collect()
    assert all((r._shard, r._slot, r._cell, r._draw) == (5, 5, 5, 5) for r in rows)
    gapless(rows, 2)


def test_query(spark):
    rows = op7_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    gapless([(r.shard, r.slot) for r in rows], SHARDS)
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in op7_sharding(spark, SF).collect()}


def test_every_place_is_as_likely(spark):
    """Shard of each row over many seeds: near uniform for every row, whatever its partition."""
    frame = docs(spark, [(i, "t") for i in range(12)]).repartition(3).cache()
    seen = collections.Counter()
    for seed in range(40):
        seen.update((r.doc_id, r._shard) for r in shuffle_to_shards(frame, 2, seed).select("doc_id", "_shard").collect())
    shares = [seen[i, 0] for i in range(12)]
    assert all(6 <= x <= 34 for x in shares) and sum(shares) == 240
    frame.unpersist()


def test_edge_rows_and_columns(spark):
    frame = docs(spark, [(None, None), (1, ""), (1, "x" * 200_000), (2, "same"), (2, "same")] + [(7, "hot")] * 60)
    out = shuffle_to_shards(frame, 5)
    assert out.columns == [*frame.columns, "_shard", "_slot"]
    rows = out.collect()
    gapless(rows, 5)
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in frame.collect())


def test_empty_table(spark):
    assert shuffle_to_shards(docs(spark, [(1, "a")]).where("false"), 3).count() == 0
