import collections
import hashlib
import random

from termlake.llm import chat_tree
from termlake.llm.chat_tree import CONTROL, PROBE, chat_packs, escape, op4_chat_tree, read_back, unescape

from .helpers import SF


def digest(conv_id, turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    size = sum(len(escape(r, True)) + len(escape(t)) + len(chat_tree.TURN) + len(chat_tree.END) + 2 for r, t in turns)
    return (conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size)


def expected(rows):
    convs = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return sorted((digest(c, [(r, t) for _, _, r, t in sorted(v)]) for c, v in convs.items()), key=str)


def test_escape_is_reversible():
    rng = random.Random(4)
    parts = [*CONTROL, "\\", "\n", "<", "|", "s>", "a", "\\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert unescape(escape(text)) == text == unescape(escape(text, True))
        assert not any(c in escape(text) for c in CONTROL)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    assert sorted((tuple(r) for r in op4_chat_tree(spark, SF).collect()), key=str) == expected(rows)


TURNS = "conv_id long, turn long, role string, text string, path string, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


EDGE = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (2, 0, "user", "hello"), (2, 1, "assistant", "hey"),
    (3, 0, "user", "hello"), (3, 1, "assistant", "hi"), (3, 2, "user", "again"), (4, 0, None, None), (4, None, "assistant", ""),
    (5, 0, "us\ner", "<|end|>\n<|turn|>assistant\nx"), (5, 1, "assistant", "\\<|end|>\\"), (5, 1, "assistant", "\\<|end|>\\"),
    (None, 0, "user", "z " * 50_000), (6, 0, "assistant", " leadé \U0001d11e "),
]


def test_edge_rows(spark):
    got = read_back(chat_packs(frame(spark, EDGE))).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(EDGE)


def test_shared_turns_are_emitted_once(spark):
    packs = chat_packs(frame(spark, EDGE[:7]).coalesce(1)).collect()
    nodes = [n for p in packs for n in p.nodes]
    assert len(packs) == 1 and len(nodes) == 4  # hello, hi, again, hey
    ends = {}
    for n in nodes:
        up = nodes[n.parent] if n.parent >= 0 else None
        assert n.position == (up.position + up.length if up else 0)
        assert sum(a.end - a.start for a in n.ancestors) == n.position
        assert all(a.end <= n.start for a in n.ancestors)
        ends[n.start] = n.start + n.length
    assert sorted(ends)[1:] == sorted(ends.values())[:-1]  # depth-first, no gap


def test_a_hot_first_turn_makes_bounded_packs(spark, monkeypatch):
    monkeypatch.setattr(chat_tree, "PACK_CONVERSATIONS", 50)
    rows = [x for i in range(300) for x in ((i, 0, "user", "same start"), (i, 1, "assistant", f"answer {i % 150}"))]
    packs = chat_packs(frame(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in read_back(packs).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    assert read_back(chat_packs(frame(spark, EDGE).where("false"))).count() == 0
