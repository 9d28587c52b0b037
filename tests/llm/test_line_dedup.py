import collections
import hashlib

import pytest

from termlake.llm.line_dedup import FANOUT, LineRuns, line_dedup, op8_line_dedup

from .helpers import SF, docs

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    """{(doc_id, text): (n_lines, n_dropped, kept)}; a null id is the largest."""
    big = 1 << 63
    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, big), big - 1 if doc_id is None else doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (big - 1 if doc_id is None else doc_id)]
        out[doc_id, text] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (n, m, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (n, m, t) in brute(rows).items()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op8_line_dedup(spark, SF).collect()}
    assert got == want
    assert any(x[1] for x in want.values())


COMMON = "a very common line"
EDGE = [
    (3, None), (4, ""), (5, f"{COMMON}\nshort\nshort\nown line of five"), (6, f"  {COMMON.upper()}\t\nshort"), (7, f"{COMMON}\n{COMMON}\n\n"),
    (2, f"x\n{COMMON}\ny\n{COMMON}"), (None, f"{COMMON}\nline of the null"), (9, "line of the null"), (10, "É" * 10), (11, "é" * 10),
    (12, "long line number " * 30_000), (13, "long line number " * 30_000), (7, f"{COMMON}\n{COMMON}\n\n"), (14, "123456789"), (15, "123456789"),
]


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_edge_rows_in_any_number_of_batches(spark, batches):
    rows = line_dedup(docs(spark, EDGE + [(100 + i, COMMON) for i in range(60)]), batches).collect()
    want = brute(EDGE + [(100 + i, COMMON) for i in range(60)])
    texts = collections.defaultdict(set)
    for d, t in want:
        texts[d].add(t)
    assert len(rows) == len(EDGE) + 60
    for r in rows:
        assert (r.n_lines, r.n_dropped, r.kept_text) in {want[r.doc_id, t] for t in texts[r.doc_id]}


LINES = "doc long, th long, at int, h1 long, h2 long"


def test_rows_without_an_id_are_documents_of_their_own(spark):
    own = [(None, f"line that {i} rows without an id hold\nline of text {i} alone") for i in (1, 1, 2)] + [(None, "line of text 2 alone\nand more of it"), ((1 << 63) - 1, "and more of it")]
    rows = line_dedup(docs(spark, own), 2).collect()
    kept = [r.kept_text for r in rows if r.doc_id is None]
    assert sum(k.count("line of text 1 alone") for k in kept) == 2  # equal texts are one document
    assert sum(k.count("line of text 2 alone") for k in kept) == 1
    assert sum(k.count("and more of it") for k in kept) == 0


def test_many_lines_in_one_document(spark):
    text = "\n".join(f"line number {i % 90_000}" for i in range(100_000))
    rows = {r.doc_id: r for r in line_dedup(docs(spark, [(1, text), (2, text + "\nand one more line")])).collect()}
    assert (rows[1].n_dropped, rows[2].n_dropped, rows[2].kept_text) == (0, 100_000, "and one more line")


def test_no_table_stays_behind(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(LineRuns, "_compact", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup(docs(spark, EDGE))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_runs_are_levelled(spark):
    runs = LineRuns(spark, buckets=2)
    for i in range(5):
        batch = spark.createDataFrame([(i, 1, k, i * 10 + k, 0) for k in range(3)], LINES)
        assert runs.add(batch, 1000).count() == 0
        assert all(len(level) < FANOUT for level in runs.levels)
    again = spark.createDataFrame([(9, 1, 4, 0, 0), (9, 1, 5, 99, 0), (9, 1, 6, 0, 7)], LINES)
    assert [(r.doc, r.at) for r in runs.add(again, 1000).collect()] == [(9, 4)]
    assert sum(spark.table(name).count() for level in runs.levels for name, _ in level) == 17
    runs.close()


def test_empty_table(spark):
    assert line_dedup(docs(spark, EDGE).where("false")).count() == 0
