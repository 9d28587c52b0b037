"""Chat formatting as prefix trees: turns that conversations share at their start are emitted once.

A turn is ``<|turn|>role`` and a line end, the text, ``<|end|>`` and a line end. Control strings inside
roles and texts are escaped: each backslash is doubled, then a backslash goes behind the first
character of a control string (and before a line end of a role); dropping the backslash of every
backslash pair restores the text.

Conversations are ordered by the chained digests of their turns, so a shared start makes neighbours and
the order is depth-first. A task walks its range and fills packs of about PACK_TOKENS tokens: a node
for each new turn, with its place in the pack, its first position id (its ancestors' tokens), the
intervals of the ancestors it attends to besides itself, and the interval under the loss (an assistant's text). A start shared across
two packs is emitted in both, so a turn that a third of all conversations share makes no large group.

Defined results: rows of one conversation are ordered by turn (null first), then role, then text; a null
role or text is empty; rows with a null conv_id are one conversation; equal conversations share all nodes.
A conversation is one row, so it must fit a task; the tokenizer's control tokens are never emitted. A very
long text is one node of its pack; an empty table gives no pack; other columns are ignored. A conversation
-1 of the table and the query's own one are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, table
from .token_files import encoder, tokenizer_path

TURN, END = "<|turn|>", "<|end|>"
# Strings that mark turns in this and in other common chat templates.
CONTROL = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>"]
CONTROLS = re.compile("|".join(map(re.escape, CONTROL)))
FORMATTED = re.compile(re.escape(TURN) + r"((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)" + re.escape(END) + "\n", re.S)
PACK_TOKENS, PACK_CONVERSATIONS = 1 << 15, 1 << 12
ASSISTANT = "assistant"
PROBE = "</s>[INST] ok [/INST]"

NODE = "struct<start:int,length:int,position:int,parent:int,ancestors:array<struct<start:int,end:int>>,loss_start:int,loss_end:int>"
PACK_SCHEMA = f"ids binary, nodes array<{NODE}>, conversations array<struct<conv_id:bigint,leaf:int>>"


def escape(text: str, line_end: bool = False) -> str:
    text = CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))
    return text.replace("\n", "\\\n") if line_end else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def ordered_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and ``path``, the digests of all its starts in order; sorted by path within ranges."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    listed = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), role, text).alias("t"))
    listed = listed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chain = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")),
        lambda acc, t: (
            lambda d: F.struct(d.alias("last"), F.concat(acc["all"], F.array(d)).alias("all"))
        )(F.md5(F.concat(acc["last"], F.md5(t["role"]), F.md5(t["text"])))),
        lambda acc: acc["all"],
    )
    return (
        listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"), chain.alias("path"))
        .repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
    )


class Pack:
    """The tree under construction: tokens in depth-first order, and the nodes of the conversation last added."""

    def __init__(self):
        self.ids, self.size, self.nodes, self.conversations, self.stack = [], 0, [], [], []

    def add(self, conv_id: int | None, path: list[str], turns: list[dict], encode) -> None:
        shared = 0
        while shared < min(len(path), len(self.stack)) and self.stack[shared][0] == path[shared]:
            shared += 1
        del self.stack[shared:]
        for digest, turn in zip(path[shared:], turns[shared:]):
            parent = self.stack[-1][1] if self.stack else -1
            parts = [encode(TURN + escape(turn["role"], True) + "\n"), encode(escape(turn["text"])), encode(END + "\n")]
            a, b, c = (len(x) // 2 for x in parts)
            up = self.nodes[parent] if self.stack else None
            ancestors, position = [], 0
            if up:
                position = up["position"] + up["length"]
                ancestors = [dict(x) for x in up["ancestors"]]
                if ancestors and ancestors[-1]["end"] == up["start"]:
                    ancestors[-1]["end"] = up["start"] + up["length"]
                else:
                    ancestors.append({"start": up["start"], "end": up["start"] + up["length"]})
            loss = (self.size + a, self.size + a + b) if turn["role"] == ASSISTANT else (self.size, self.size)
            self.nodes.append(
                {"start": self.size, "length": a + b + c, "position": position, "parent": parent, "ancestors": ancestors, "loss_start": loss[0], "loss_end": loss[1]}
            )
            self.stack.append((digest, len(self.nodes) - 1))
            self.ids += parts
            self.size += a + b + c
        self.conversations.append({"conv_id": conv_id, "leaf": self.stack[-1][1]})

    def full(self) -> bool:
        return self.size >= PACK_TOKENS or len(self.conversations) >= PACK_CONVERSATIONS

    def row(self) -> dict:
        return {"ids": b"".join(self.ids), "nodes": self.nodes, "conversations": self.conversations}


def control_free(path: str) -> Callable[[str], bytes]:
    """16-bit ids of texts in which the strings of added tokens are ordinary text."""
    encode, dtype = encoder(path, as_text=True)
    if dtype != "<u2":
        raise ValueError("packs hold 16-bit ids: the vocabulary is too large")
    return encode


def chat_packs(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each pack: ids (16-bit little-endian), nodes and conversations (conv_id and its last node)."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = control_free(path), Pack()
        schema = None
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                pack.add(row["conv_id"], row["path"], row["turns"], encode)
                if pack.full():
                    schema = schema or arrow_schema()
                    yield pa.RecordBatch.from_pylist([pack.row()], schema)
                    pack = Pack()
        if pack.conversations:
            yield pa.RecordBatch.from_pylist([pack.row()], schema or arrow_schema())

    return ordered_conversations(turns).mapInArrow(run, PACK_SCHEMA)


def arrow_schema() -> pa.Schema:
    i = pa.int32()
    interval = pa.struct([("start", i), ("end", i)])
    node = pa.struct([("start", i), ("length", i), ("position", i), ("parent", i), ("ancestors", pa.list_(interval)), ("loss_start", i), ("loss_end", i)])
    return pa.schema([("ids", pa.binary()), ("nodes", pa.list_(node)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", i)])))])


def read_back(packs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The digest of every conversation, from the packs alone: its tokens are its ancestors' intervals and its own node."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        decode = Tokenizer.from_file(path).decode
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.slice(i, 1).to_pylist()[0]
                ids, nodes = np.frombuffer(pack["ids"], "<u2"), pack["nodes"]
                cache: dict[tuple[int, int], str] = {}

                def text(a: int, b: int) -> str:
                    if (a, b) not in cache:
                        cache[a, b] = decode(ids[a:b].tolist(), skip_special_tokens=False)
                    return cache[a, b]

                out = []
                for conversation in pack["conversations"]:
                    chain, at = [], conversation["leaf"]
                    while at >= 0:
                        chain.append(nodes[at])
                        at = nodes[at]["parent"]
                    chain.reverse()
                    seen = [(x["start"], x["end"]) for x in chain[-1]["ancestors"]]
                    tokens = sum(b - a for a, b in seen)
                    if tokens != chain[-1]["position"] or tokens != sum(n["length"] for n in chain[:-1]):
                        raise RuntimeError("position ids and ancestor intervals disagree")
                    formatted = "".join(text(n["start"], n["start"] + n["length"]) for n in chain)
                    turns = [(unescape(r), unescape(t)) for r, t in FORMATTED.findall(formatted)]
                    loss = "".join(unescape(text(n["loss_start"], n["loss_end"])) for n in chain if n["loss_end"] > n["loss_start"])
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((conversation["conv_id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], COLUMNS)

    return packs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, ("bigint", "bigint", "string", "bigint", "string", "bigint"))))


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    packs, _ = persisted(chat_packs(turns.unionByName(probe)), "chat-packs")
    return read_back(packs)


_CONTROL_SQL = "|".join(re.sub(r"([\[\]|/<>])", r"\\\1", c) for c in CONTROL)
ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, '{ASSISTANT}', '{PROBE}'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '{_CONTROL_SQL}'))
         + length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '{_CONTROL_SQL}|\n'))
         + {len(TURN) + len(END) + 2} AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{ASSISTANT}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{ASSISTANT}'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
