import hashlib
import random
import re

from termlake.llm.secret_scan import BASE, op9_secret_scan, secret_scan

from .helpers import SF, docs, saved

KINDS = [*BASE, "random"]
PLAIN = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            if len(m[1] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((m.start(), KINDS.index(kind), kind, m.end()))
    return sorted(spans)


def check(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        want = brute(texts[row.doc_id])
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[2] == k for s in want) for k in BASE]
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if not s.startswith("random")] == [s for s in line.split(",") if s]
        keys = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)


def test_base_spans_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op9_secret_scan(spark, SF).collect(), texts)


def test_edge_texts(spark, tmp_path):
    rng = random.Random(1)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(b64) for _ in range(40))
    texts = {
        0: None,
        1: "",
        2: "secret: token = abcdefgh",
        3: "TOKEN=\"abcdefgh\" é Api_Key : 'x.y-z_0=' password==abc",
        4: "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA",
        5: "0123456789abcdef01234567 0123456789abcdef0123456",
        6: f"clef {key} fin",
        7: "pass " * 50_000 + "token=abcdef",
        8: "𝄞 token=zzzzzz",
        9: "chapter-one-of-two-2024 the-long-and-winding-road-1 aaaaaaaaaaaaaaaaaaaaaa1",
    }
    path = saved(spark, docs(spark, [*texts.items(), (6, texts[6])]), tmp_path)
    rows = op9_secret_scan(spark, path).collect()
    assert sum(r.doc_id == 6 for r in rows) == 2
    check(list({r.doc_id: r for r in rows}.values()), texts)
    found = {r.doc_id: r.spans for r in rows}
    assert found[6] == "random:5:45"
    assert "random" not in found[9]


def test_empty_table(spark):
    assert secret_scan(docs(spark, [(1, "a")]).where("false")).count() == 0
