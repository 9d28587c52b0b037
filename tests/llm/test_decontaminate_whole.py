"""Items shorter than a window at any place of a document, and windows beside a slot that disagrees."""

import pytest

from termlake.llm import decontaminate
from termlake.llm.decontaminate import decontaminated, leaks

from .helpers import docs

FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do"


@pytest.mark.parametrize("most", [decontaminate.MOST_BROADCAST, 0])
def test_short_items_inside_documents(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    items = [(1, "only three words"), (2, "where 7 meets 7"), (3, "solitary"), (4, "five of these are here"), (5, None), (6, "")]
    texts = [
        (1, f"{FILLER} only three words {FILLER}"),
        (2, f"{FILLER} where 8 meets 8"),
        (3, f"where 8 meets 9 {FILLER}"),  # one value for two
        (4, "solitary"),
        (5, f"{FILLER} five of these are"),  # a part of an item
        (6, "Only three words"),
        (7, "five of these are here and only three words"),
        (8, "a solitary man"),
        (9, FILLER),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks(docs(spark, texts), bench).select("doc_id", "item_id", "coverage").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0), (6, 1, 1.0), (7, 1, 1.0), (7, 4, 1.0), (8, 3, 1.0)]
    assert sorted(r.doc_id for r in decontaminated(docs(spark, texts), bench).collect()) == [3, 5, 9]


def test_only_windows_with_a_disagreeing_slot_are_dropped(spark):
    words = [f"word{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60)]
    item = " ".join([*words[:5], "3", *words[5:50], "5", *words[50:]])
    changed = " ".join([*words[:5], "4", *words[5:50], "4", *words[50:]])
    other = " ".join(["3", "the", "5", "words"] * 6)
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    rows = leaks(docs(spark, [(1, changed), (2, other.replace("3", "4").replace("5", "4")), (3, item)]), bench).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert set(found) == {(1, 1), (3, 1)}
    windows = 62 - 5
    assert found[1, 1].coverage == pytest.approx((windows - 12) / windows) and found[1, 1].n_slots == 0
    assert found[3, 1].coverage == 1 and found[3, 1].n_slots == 2


def test_rare_names_of_a_large_vocabulary_are_known(spark):
    """The item's names stand once; 20,100 others stand twice."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["Q" + letters[i // 676 % 26 + 0] + letters[i // 26 % 26] + letters[i % 26] + letters[i // 17576] for i in range(20_100)]
    item = "we saw Zorbo near Xilbon with Zarbos and Vilmon under Tembor by Kolbin then Palvis over Rendok"
    bench = spark.createDataFrame([(1, item), (2, " a ".join(["a", *names])), (3, " a ".join(["a", *names]))], "item_id long, text string")
    found = leaks(docs(spark, [(1, item.lower()), (2, FILLER), (3, None)]), bench).where("item_id = 1").collect()
    assert [(r.doc_id, r.coverage) for r in found] == [(1, 1.0)]


@pytest.mark.parametrize("most", [decontaminate.MOST_BROADCAST, 0])
def test_joined_words_decide_as_those_in_the_plan(spark, monkeypatch, most):
    items = [(1, "The duke saw Anna near Bonn and paid 7 dollars to Anna"), (1, "The duke saw Anna near Bonn and paid 7 dollars to Anna"), (2, "Near the mill, Otto met the duke"), (None, "Duke of mill"), (3, None)]
    texts = [(1, "the duke saw anna near bonn and paid 8 dollars to anna"), (1, "the duke saw anna near bonn and paid 8 dollars to anna"), (2, "Near The Mill, OTTO met the Duke"), (None, "near the mill, Karl met the duke"), (4, ""), (5, "Duke of mill")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    want = sorted(map(str, leaks(docs(spark, texts), bench).collect()))
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 0)
    assert sorted(map(str, leaks(docs(spark, texts), bench).collect())) == want and len(want) == 2
