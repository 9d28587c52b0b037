import collections
import hashlib
import re

from pyspark.sql import functions as F

from termlake.llm import mixing
from termlake.llm.mixing import BUDGET, EPOCHS, SEED, WEIGHTS, mix, op10_mixing, repeated

from .helpers import SF, docs


def brute(rows):
    """{(doc_id, text, source): [(size, source_size, target, repeats) of each row]} by filling and redistributing step by step."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    budget, open_, target = BUDGET * sum(total.values()), set(order), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= EPOCHS * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(EPOCHS * total[s])
            budget -= target[s]
        open_ -= full
    out = {}
    for s in order:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, at = round(target[s], 6) - whole * total[s], 0
        drawn = collections.defaultdict(list)
        for d, t, x in rows:
            if x == s:
                drawn[hashlib.md5(f"{SEED}:{'' if d is None else d}:{t or ''}".encode()).hexdigest()].append((d, t))
        for draw in sorted(drawn):
            for d, t in drawn[draw]:  # equal rows one after the other
                n = size(t)
                at += n
                out.setdefault((d, t, s), []).append((n, total[s], round(target[s], 3), whole + (rest > 0 and at - n / 2 <= rest)))
    return out


def check(frame, rows):
    want = brute(rows)
    got = mix(frame).collect()
    assert len(got) == len(rows)
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id, r.text, r.source].append((r._size, r._source_size, round(r._target, 3), r._repeats))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    return got


def test_query(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    check(frame, rows)
    out = op10_mixing(spark, SF)
    first = sorted(map(tuple, out.collect()))
    assert first == sorted(map(tuple, op10_mixing(spark, SF).collect()))
    taken, largest, targets = collections.Counter(), collections.Counter(), {}
    source = {d: s for d, _, s in rows}
    for r in out.collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        targets[s] = r.target
        assert r.taken <= EPOCHS * r.size
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    assert abs(sum(targets.values()) - BUDGET * sum(r[1] for r in first)) < 1


def test_edge_rows_and_columns(spark):
    rows = [(i, f"word {i} " * (i % 7), "en", f"s{i % 4}") for i in range(200)]
    rows += [(None, None, "en", None), (5, "", "en", "s1"), (7, "x " * 30_000, "en", None), (8, "none of these", "en", "empty"), (9, None, "en", "blank"), (3, "twice", "en", "s1"), (3, "twice", "en", "s1")]
    frame = docs(spark, rows)
    check(frame, [(d, t, s) for d, t, _, s in rows])
    again = repeated(frame)
    assert again.columns == frame.columns
    want = brute([(d, t, s) for d, t, _, s in rows])
    counts = collections.Counter((r.doc_id, r.text, r.source) for r in again.collect())
    assert counts == +collections.Counter({k: sum(int(x[3]) for x in v) for k, v in want.items()})


def test_rows_that_share_a_draw_are_counted_off(spark):
    rows = [(None, "the same four words", "en", "hot")] * 1000 + [(i, "a b c d e", "en", "wide") for i in range(300)]
    frame = docs(spark, rows).repartition(5)
    got = check(frame, [(d, t, s) for d, t, _, s in rows])
    for source in ("hot", "wide"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r._size * r._repeats for r in mine) - mine[0]._target) <= 5
    counts = collections.Counter(r.source for r in repeated(frame).collect())
    assert counts["hot"] * 4 + counts["wide"] * 5 == sum(r._size * r._repeats for r in got)


NAMES = [*mixing.RESULTS, "_draw", "_whole", "_last", "_part", "_copies", "_source", "_salt", "_place", "_copy", "s", "p", "count", "start", "bucket", "last", "copies"]


def test_names_that_clash_keep_their_values(spark):
    rows = [(None, "the same four words", "en", "hot")] * 40 + [(i, "a b c", "en", "wide") for i in range(9)]
    frame = docs(spark, rows).withColumns({n: F.lit(-5) for n in NAMES})
    mixed = mix(frame)
    assert mixed.columns[: len(frame.columns)] == frame.columns and len(set(mixed.columns)) == len(frame.columns) + 4
    plain = collections.Counter((r.doc_id, r._repeats) for r in mix(docs(spark, rows)).collect())
    assert plain == collections.Counter((r[0], r[-1]) for r in mixed.collect())
    out = repeated(frame)
    assert out.columns == frame.columns
    assert all(r[n] == -5 for r in out.collect() for n in NAMES) and out.count() == sum(k[1] * n for k, n in plain.items())


def test_many_sources_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rows = [(i, f"a b c {i}", "en", f"s{i % 9}") for i in range(90)]
    check(docs(spark, rows), [(d, t, s) for d, t, _, s in rows])


def test_empty_tables(spark):
    frame = docs(spark, [(1, "a")])
    assert mix(frame.where("false")).count() == 0
    assert repeated(docs(spark, [(1, None), (2, " ")])).count() == 0
