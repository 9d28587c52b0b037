import itertools
import random
import re
from fractions import Fraction

import pytest

from termlake.llm.filter_audit import FILTERS, RemovalPolynomial, filter_audit
from termlake.llm.queries import ORACLES, QUERIES

from ..test_queries import oracle, table  # noqa: F401
from .helpers import SF, docs

LABELS = "doc_id long, quality int, toxic int, lang string"


def fails(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    same = [i for i, other, *_ in rows if (other or "") == text and i is not None]
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and doc_id > min(same),
    }


def brute(rows, labels):
    """Every order applied to every document, one filter after the other."""
    flagged = lambda i, k: i is not None and any(r[0] == i and r[k] == 1 for r in labels)
    parts = {}
    for doc_id, text, lang, _ in rows:
        mask = {f for f, bad in fails(text or "", doc_id, rows).items() if bad}
        parts.setdefault(lang or "", []).append((mask, flagged(doc_id, 1), flagged(doc_id, 2)))
    out = []
    for part, members in parts.items():
        total, steps = dict.fromkeys(FILTERS, 0), []
        for order in itertools.permutations(FILTERS):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                failing = sum(f in m[0] for m in members)
                total[f] += len(gone)
                alone = sum(m[0] == {f} for m in members)
                steps.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(m[1] for m in gone), sum(m[2] for m in gone)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_equals_brute_force_on_edge_rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, 220)), " ".join(rng.choices(words[:20], k=300)), "LOUD WORDS " * 10, "a # b", "", "é" * 50, " \t\n", " ".join(rng.sample(words, 250)) + " $"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), "s") for i in range(60)]
    rows += [(70, None, "en", "s"), (71, "", "", "s"), (5, rows[5][1], "en", "s"), (5, "other", "en", "s"), (None, texts[0], None, "s"), (None, "a # b", "en", "s"), (None, None, "fr", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "x") for i in range(40)] + [(3, 0, 0, "x"), (3, 1, 1, "x"), (None, 1, 1, "x"), (5000, 1, 1, "x")]
    found = filter_audit(docs(spark, rows), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, labels)


def test_long_text_and_many_copies(spark):
    rows = [(i, "same text " * 3, "en", "s") for i in range(500)] + [(900, " ".join(f"w{i}" for i in range(200_000)), "en", "s")]
    found = {(r.filter_order, r.step): r for r in filter_audit(docs(spark, rows), spark.createDataFrame([], LABELS)).collect()}
    assert found["EABCD", 1].removed == 499 and found["EABCD", 5].kept == 1
    assert found["AEBCD", 1].removed == 500 and found["AEBCD", 2].redundant == 499


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_tables(spark, labelled):
    assert filter_audit(docs(spark, []), spark.createDataFrame([(1, 1, 1, "x")] if labelled else [], LABELS)).count() == 0


def test_polynomial_against_sums_over_orders():
    rng = random.Random(8)
    for _ in range(20):
        counts = {frozenset(m): rng.randrange(10**6) for k in range(6) for m in itertools.combinations(FILTERS, k) if rng.random() < 0.6}
        p = RemovalPolynomial(counts)
        for size in range(6):
            for applied in map(frozenset, itertools.combinations(FILTERS, size)):
                assert p.at_corner(applied) == sum(n for m, n in counts.items() if m & applied)
        for f in FILTERS:
            assert p.shapley(f) == sum(Fraction(n, len(m)) for m, n in counts.items() if f in m)
        assert sum(map(p.shapley, FILTERS)) == p.at_corner(frozenset(FILTERS))


def test_equals_sql(spark, oracle):  # noqa: F811
    name = "op13_filter_audit"
    assert table(QUERIES[name](spark, SF).toPandas()) == table(oracle.execute(ORACLES[name]).df())
