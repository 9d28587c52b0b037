"""Repeated and wordless windows, long documents of one window, and the shuffle branches."""

import pytest

from termlake.llm import decontaminate
from termlake.llm.decontaminate import decontaminated, leaks

from .helpers import docs

ROW = " ".join(str(i) for i in range(300, 340))
SAME = " ".join(["7"] * 40)
PAIRS = " ".join(["apples 8"] * 20)


@pytest.mark.parametrize("most", [decontaminate.MOST_BROADCAST, 0])
def test_repeated_and_wordless_windows(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    bench = spark.createDataFrame([(1, ROW), (2, SAME), (3, PAIRS)], "item_id long, text string")
    texts = [
        (1, " ".join(map(str, range(50_000)))),  # holds item 1; other rows of numbers are no template of it
        (2, " ".join(["7"] * 50_000)),
        (3, " ".join(["apples 9"] * 20_000)),  # re-parameterised
        (4, " ".join(map(str, range(1000, 1500)))),
        (5, "7 7 7 7 7 7 7 7"),  # 3 of 35 windows
        (6, " ".join(f"apples {i}" for i in range(40))),  # three values for one
        (7, " ".join(["apples 4"] * 10)),  # 15 of 35 windows
        (None, "ａｂ ｃ ｄ ｅ ｆ ｇ"),
    ]
    rows = leaks(docs(spark, texts), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (2, 2), (3, 3), (7, 3)]
    assert sorted(r.doc_id for r in decontaminated(docs(spark, texts), bench).collect() if r.doc_id) == [4, 5, 6]


def test_windows_that_items_share_make_no_candidates(spark):
    intro = "read the question below and answer it with one word only please"
    bench = spark.createDataFrame([(i, f"{intro} " + " ".join(f"q{'abcdefghij'[i]}z{'abcdefghijklmnopqrst'[k]}" for k in range(20))) for i in range(8)], "item_id long, text string")
    kept = decontaminate.anchors(decontaminate.windows(bench, ["item_id"], decontaminate.F.array(decontaminate.F.lit(6))))[1]
    shared = {r.hash for r in decontaminate.windows(spark.createDataFrame([(0, intro)], "item_id long, text string"), ["item_id"], decontaminate.F.array(decontaminate.F.lit(6))).collect()}
    assert not shared & {r.hash for r in kept.collect()}
    texts = [(1, intro * 5), (2, bench.first().text)]
    assert [(r.doc_id, r.item_id) for r in leaks(docs(spark, texts), bench).collect()] == [(2, 0)]


def test_names_that_clash(spark):
    bench = spark.createDataFrame([(1, ROW)], "item_id long, text string")
    frame = docs(spark, [(1, ROW), (2, "other words")]).withColumns({c: decontaminate.F.lit(5) for c in ("_bad_id", "_bad_th", "_th", "_w", "_t", "at", "size", "hash")})
    left = decontaminated(frame, bench)
    assert left.columns == frame.columns
    assert [tuple(r) for r in left.collect()] == [tuple(r) for r in frame.where("doc_id = 2").collect()]
