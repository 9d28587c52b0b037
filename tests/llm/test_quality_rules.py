import re

from termlake.llm.quality_rules import RULES, measured, op2_quality_rules, quality_rules

from .helpers import SF, docs

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, repeated = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated |= {p + k for p in places for k in range(8)}
    n, rep = len(w), len(repeated)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, texts)


def test_clean_texts_are_kept(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").join(op2_quality_rules(spark, SF), "doc_id").where("NOT base_failed")
    assert good.where("NOT kept").count() == 0


def test_edge_texts(spark):
    eight = "a b c d e f g h"
    texts = {
        1: None, 2: "", 3: " \n\t\n ", 4: "one\none\n one", 5: f"{eight} {eight}", 6: f"{eight} x {eight} i {eight}", 7: "é𝄞 | # <> *\x0b\x0cb",
        8: "word " * 50_000, 9: " ".join(f"w{i}" for i in range(40_000)), 10: "a a a a a a a a a",
    }
    out = quality_rules(docs(spark, [*texts.items(), (5, texts[5]), (None, "x")]))
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    check([r for r in rows if r.doc_id is not None], texts)


def test_empty_table_and_one_projection(spark):
    out = quality_rules(docs(spark, [(1, "a")]).where("false"))
    assert out.count() == 0
    plan = quality_rules(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert len({r.name for r in RULES}) == len(RULES)


def test_columns_of_any_name_stay(spark):
    frame = docs(spark, [(1, "some words here"), (2, None)]).withColumnsRenamed({"lang": "_words", "source": "_hashes", "n_chars": "_Lines"})
    rows = measured(frame, prefix="m_").collect()
    assert [(r["_words"], r["_hashes"]) for r in rows] == [("en", "src0")] * 2 and sorted(r.m_n_words for r in rows) == [0, 3]
