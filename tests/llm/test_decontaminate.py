import collections

import pytest
import regex

from termlake.llm.decontaminate import MIN_COVERAGE, UNITS, WINDOW, decontaminated, leaks, op3_decontaminate

from .helpers import SF, docs

UNIT = "|".join(sorted(UNITS, key=len, reverse=True))


def known(items):
    """Words that items write small more often than with a capital behind a small letter, digit, comma or semicolon, and their other words with a capital."""
    n, capital = collections.Counter(), set()
    for text in items.values():
        for m in regex.finditer(r"[\p{L}\p{M}']+", text or ""):
            word, before = m[0], text[: m.start()]
            if word[0].islower():
                n[word.lower()] += 1
            elif word[0].isupper() and inside(before):
                n[word.lower()] -= 1
                capital.add(word.lower())
            elif word[0].isupper() and word[1:2] and (word[1].islower() or word[1] == "'"):
                capital.add(word.lower())
    return {w for w, k in n.items() if k > 0}, {w for w in capital if n[w] <= 0}


def inside(before):
    return len(before) > 1 and before[-1] == " " and (before[-2].islower() or before[-2].isnumeric() or before[-2] in ",;")


def is_name(word, before, words):
    common, names = words
    if word[0].isupper() and (inside(before) or len(word) > 1 and (word[1].islower() or word[1] == "'") and word.lower() not in common):
        return True
    return word.lower() in names


def tokens(text, words):
    """(type, value) of the template tokens, by a scan of its own."""
    out = []
    scan = regex.compile(rf"(?P<n>\p{{N}}+(?:[.,:/]\p{{N}}+)*)(?: ?(?P<u>(?i:{UNIT}))(?![\p{{L}}\p{{N}}]))?|(?P<w>[\p{{L}}\p{{M}}']+)")
    for m in scan.finditer(text or ""):
        if m["n"]:
            out.append(("#n", m["n"]))
            if m["u"]:
                out.append(("#u", m["u"].lower()))
        else:
            out.append(("#p" if is_name(m["w"], text[: m.start()], words) else m["w"].lower(), m["w"].lower()))
    return out


def brute(texts, items):
    def wins(t):
        return [tuple(x[0] for x in t[i : i + WINDOW]) for i in range(max(1, len(t) - WINDOW + 1))] if t else []

    index = collections.defaultdict(list)
    words = known(items)
    item_tokens = {k: tokens(v, words) for k, v in items.items()}
    for k, t in item_tokens.items():
        for i, w in enumerate(wins(t)):
            index[w].append((k, i))
    found = set()
    for d, text in texts:
        t = tokens(text, words)
        diagonals = collections.defaultdict(set)
        for j, w in enumerate(wins(t)):
            for k, i in index.get(w, ()):
                diagonals[k, j - i].add(i)
        met = collections.defaultdict(set)
        for (k, shift), places in diagonals.items():
            pairs = {(item_tokens[k][i + x], t[i + x + shift]) for i in places for x in range(min(WINDOW, len(t))) if i + x < len(item_tokens[k])}
            pairs = {p for p in pairs if p[0][0][0] == "#"}
            if len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(pairs):
                met[k] |= places
        for k, places in met.items():
            if len(places) / len(wins(item_tokens[k])) >= MIN_COVERAGE:
                found.add((d, k))
    return found


def test_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = op3_decontaminate(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(texts, items)
    assert len(rows) > 0


@pytest.fixture
def bench(spark):
    item = "A shop sells pens to Anna for 12 dollars each and Anna pays 24 dollars for a box of pens, so how many pens did Anna buy?"
    return spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "only three words")], "item_id long, text string")


CASES = [
    (1, "x y z. A shop sells pens to Bob for 15 dollars each and Bob pays 30 dollars for a box of pens, so how many pens did Bob buy? end"),
    (2, "A shop sells pens to Bob for 15 dollars each and Carl pays 15 dollars for a box of pens, so how many pens did Dora buy?"),
    (3, None),
    (4, ""),
    (5, "Only three words"),
    (6, "something else entirely about a shop that sells pens"),
    (1, "x y z. A shop sells pens to Bob for 15 dollars each and Bob pays 30 dollars for a box of pens, so how many pens did Bob buy? end"),
    (7, "lorem ipsum dolor " * 40_000 + "a shop sells pens to Eve for 1 dollars each and Eve pays 2 dollars for a box of pens, so how many pens did Eve buy?"),
]


def test_slots_and_edges(spark, bench):
    rows = leaks(docs(spark, CASES), bench).select("doc_id", "item_id").distinct().collect()
    items = {r.item_id: r.text for r in bench.collect()}
    want = brute(CASES, items)
    assert {tuple(r) for r in rows} == want
    assert want == {(1, 1), (7, 1), (5, 4)}  # document 2 puts one value for two of the item's


def test_rows_that_stay_keep_their_columns(spark, bench):
    frame = docs(spark, CASES)
    left = decontaminated(frame, bench)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 6]


def test_empty_tables(spark, bench):
    frame = docs(spark, CASES)
    assert leaks(frame.where("false"), bench).count() == 0
    assert decontaminated(frame, bench.where("false")).count() == len(CASES)


def asked(one, verbs, a, b):
    """A question whose name stands at the starts of its sentences."""
    return f"{one} {verbs[0]} {a} apples. {one} {verbs[1]} {b} apples. {one} keeps the rest. How many?"


FORMS = {
    "plain": "{}", "quoted": 'He said: "{}"', "in brackets": "({})", "on a line": "Question\n{}", "behind a sentence": "Nothing here matters. {} The end.",
    "listed": "1. {}", "behind a dash": "see below - {}", "typeset quote": "\u201c{}\u201d",
}


@pytest.mark.parametrize("rest", ["", "how the rest of it buys many and keeps the sells"])
def test_names_at_the_start_of_sentences(spark, rest):
    items = spark.createDataFrame([(1, asked("Anna", ("buys", "sells"), 12, 5)), (2, rest)], "item_id long, text string")
    texts = [(i, form.format(asked("Tom", ("buys", "sells"), 30, 7))) for i, form in enumerate(FORMS.values())]
    texts += [(20, asked("Anna", ("buys", "sells"), 8, 3).lower())]  # a copy in other case
    texts += [(50, asked("Tom", ("paints", "wraps"), 30, 7).replace("keeps", "forgets")), (51, asked("Tom", ("buys", "sells"), 30, 30)), (52, "How many? Tom waits. Tom goes.")]
    texts += [(53, "Tom buys 30 apples. Carl sells 7 apples. Eve keeps the rest. How many?")]  # three names for one
    found = {r.doc_id: r.coverage for r in leaks(docs(spark, texts), items).where("item_id = 1").collect()}
    assert set(found) == {*range(len(FORMS)), 20} and min(found.values()) >= 0.8


def test_a_common_word_at_a_start_is_no_name(spark):
    items = spark.createDataFrame([(1, "Where does the river begin to bend and where does it end? Where exactly is that place now")], "item_id long, text string").unionByName(
        spark.createDataFrame([(2, "we ask Will, for Will, if Will will come to Berlin soon and then leaves")], "item_id long, text string")
    )
    texts = [(1, "There does the river begin to bend and there does it end? There exactly is this place now"), (2, "Where does the river begin to bend and where does it end? Where exactly is that place now")]
    assert [r.doc_id for r in leaks(docs(spark, texts), items).collect()] == [2]


def test_words_in_capitals_and_repeated_rows(spark):
    item = "THE SHOP SELLS PENS TO THE MAN WHO DOESN'T GIVE O'NEIL A LOT OF MONEY, isn't so, O'Neil said"
    items = spark.createDataFrame([(1, item), (1, None)], "item_id long, text string")
    texts = [(1, item), (1, item), (2, item.lower()), (3, "A BOAT BUYS CARS FROM A CAT WITH NO BIT AT ALL"), (4, "Xx " * 50), (5, None)]
    assert sorted({r.doc_id for r in leaks(docs(spark, texts), items).collect()}) == [1, 2]
