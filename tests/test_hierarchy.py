"""Deep, wide, broken and circular hierarchies against plain walks."""

import random

import pytest

from termlake.operators import hierarchy as h

EDGE = "code string, parent_code string"


def frame(spark, edges):
    return spark.createDataFrame(edges, EDGE)


def forest(n, seed, width=5):
    rng = random.Random(seed)
    return [(f"n{i}", None if i == 0 or rng.random() < 0.03 else f"n{rng.randrange(max(0, i - width), i)}") for i in range(n)]


def up_of(edges):
    return {c: p for c, p in edges}


def walk(up, code):
    chain = [code]
    while up.get(chain[0]) is not None:
        chain.insert(0, up[chain[0]])
    return chain


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    chain = frame(spark, [(f"c{i}", f"c{i - 1}" if i else None) for i in range(n)])
    ends = spark.createDataFrame([(f"c{n - 1}",), ("c5",)], "code string")
    found = {(r.code, r.ancestor): r.position for r in h.ancestors(chain, ends).collect()}
    assert len(found) == n + 6 and found[f"c{n - 1}", "c0"] == 1 and found[f"c{n - 1}", f"c{n - 1}"] == n and found["c5", "c3"] == 4
    down = {(r.root, r.code): r.depth for r in h.descendants(chain, spark.createDataFrame([("c0",), (f"c{n - 3}",)], "code string")).collect()}
    assert len(down) == n + 3 and down["c0", f"c{n - 1}"] == n - 1 and down[f"c{n - 3}", f"c{n - 1}"] == 2
    numbered = h.intervals(chain)
    assert h.inside(numbered, "c40").count() == n - 40 and numbered.where("code = 'c77'").first()["depth"] == 77


@pytest.mark.parametrize("width", [1, 4, 300])
def test_forests_against_walks(spark, width):
    edges = forest(300, width, width) + [("orphan", "nowhere"), ("below", "orphan"), (None, "n1")]
    up = up_of(edges[:-1])
    codes = [c for c, _ in edges[:-1]] + ["nowhere"]
    concepts = frame(spark, edges)
    chains = {c: walk(up, c) for c in codes}
    asked = spark.createDataFrame([(c,) for c in codes[::7]] + [("unknown",), (codes[0],)], "code string")
    want = {(c, a, i) for c in [*codes[::7], "unknown"] for i, a in enumerate(chains.get(c, [c]), 1)}
    assert {tuple(r) for r in h.ancestors(concepts, asked).collect()} == want
    want = {(r, c, len(chains[c]) - 1 - chains[c].index(r)) for r in codes[::7] for c in codes if r in chains[c]} | {("unknown", "unknown", 0)}
    assert {tuple(r) for r in h.descendants(concepts, asked).collect()} == want
    rows = {r.code: r for r in h.intervals(concepts).collect()}
    assert set(rows) == set(codes)
    for c in codes:
        assert (rows[c].root, rows[c].depth) == (chains[c][0], len(chains[c]) - 1)
    for y in codes[::5]:
        below = {x for x in codes if rows[x].root == rows[y].root and rows[y].low <= rows[x].low <= rows[y].high}
        assert below == {x for x in codes if y in chains[x]}


def test_circles_raise_where_they_are_met(spark):
    edges = [("r", None), ("a", "r"), ("x", "z"), ("y", "x"), ("z", "y"), ("tail", "z"), ("end", "tail"), ("self", "self")]
    concepts, codes = frame(spark, edges), lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    for asked in ("x", "tail", "end", "self"):
        with pytest.raises(h.CycleFound):
            h.ancestors(concepts, codes("a", asked))
    for asked in ("x", "y", "z", "self"):
        with pytest.raises(h.CycleFound):
            h.descendants(concepts, codes("r", asked))
    with pytest.raises(h.CycleFound):
        h.intervals(concepts)
    assert sorted(tuple(r) for r in h.descendants(concepts, codes("r", "tail")).collect()) == [("r", "a", 1), ("r", "r", 0), ("tail", "end", 1), ("tail", "tail", 0)]
    assert sorted(tuple(r) for r in h.ancestors(concepts, codes("a")).collect()) == [("a", "a", 2), ("a", "r", 1)]


def test_empty(spark):
    none = frame(spark, [])
    assert h.intervals(none).count() == 0 and h.descendants(none, spark.createDataFrame([("a",)], "code string")).count() == 1
    assert h.reachable(none, spark.createDataFrame([], "code string")).count() == 0


@pytest.mark.parametrize("circles", [False, True])
def test_reachable_over_several_parents(spark, circles):
    rng = random.Random(9 + circles)
    edges = {(f"d{i}", f"d{rng.randrange(i)}") for i in range(1, 150) for _ in range(rng.choice([1, 1, 2, 3])) if rng.random() < 0.9}
    edges |= {(f"deep{i}", f"deep{i - 1}") for i in range(1, 400)} | {("deep0", "d140")}
    if circles:
        edges |= {(f"d{rng.randrange(40)}", f"d{rng.randrange(150)}") for _ in range(12)} | {("deep5", "deep300"), ("s", "s")}
    start = ["d7", "d100", "missing"]
    reached, front = set(start), list(start)
    while front:
        front = [c for c, p in edges if p in front and c not in reached]
        reached |= set(front)
    found = [r.code for r in h.reachable(frame(spark, sorted(edges)), spark.createDataFrame([(c,) for c in start], "code string")).collect()]
    assert sorted(found) == sorted(reached)


def test_ancestry_cuts_circles_where_they_are(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "z"), ("x", "y"), ("y", "x"), ("y", "zz"), ("w", "x"), ("e", "e"), ("f", "gone")] + [(f"k{i:03}", f"k{i - 1:03}") for i in range(1, 60)]
    codes = sorted({c for c, _ in edges} | {"a", "z", "zz", "k000"})
    parents = {c: sorted(p for x, p in edges if x == c and p in codes) for c in codes}

    def chain(code):
        out = [code]
        while left := [p for p in parents[out[0]] if p not in out]:
            out.insert(0, left[0])
        return out

    labels = spark.createDataFrame([(c, c.upper()) for c in codes], "code string, label string")
    found = h.ancestry(labels, frame(spark, edges), labels.select("code").where("false")).collect()
    assert {r.code: r.chain for r in found} == {c: chain(c) for c in codes} and all(r.level == len(r.chain) for r in found)
