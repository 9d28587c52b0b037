"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Three passes: texts become ids (one table, compressed), each chunk of texts cut into the tokenizer's pieces
at once and each different piece looked up once; a count over all ids ranks them, most
frequent first; documents in ascending doc_id order become blocks of ranks. A rank takes 1 to 4 bytes;
its length minus one is a 2-bit code, four codes to a control byte, control bytes apart from data bytes.
Decoding finds the lengths of a whole block by a table of 256 rows and gathers bytes with numpy.

A file set is two Parquet tables in one folder: ``blocks`` (part, at, doc_ids, counts, control, data)
and ``ranks`` (one row: the ids in rank order). Parquet is the container, so any store Spark writes will do.

Defined results: null text counts as empty and gives the end id alone; rows that share a doc_id follow
each other in order of their text's hash, equal texts one after the other; a null doc_id comes first; a very
long text is one block of its own and is encoded by one task; an empty table writes no block; other columns
of the input are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, persisted, release_unused, shared_dir, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_TOKENS = 1 << 16
CHUNK_BYTES = 1 << 22  # of text that a task cuts into pieces at once; a longer text is a chunk of its own
MOST_CACHED, CACHED_CHARS = 250_000, 48  # units in each generation of a worker's two dictionaries, 50 MB a generation at most

LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class NotLone(ValueError):
    """A space was split off that has another space beside it or ends its text."""


class UnitIds(dict):
    """Token bytes (little-endian) by unit of text: the part from one lone space to the next.

    A byte-level tokenizer splits a text before each single space between two other characters, and a unit's
    tokens don't depend on its surroundings, so equal units are encoded once. It also splits between
    letters and marks and around a line end, so such units are put together from words and marks.

    A full dictionary becomes the older generation, in place of the one before it; what is asked for again
    comes back from there, so frequent units outlast the many that occur once.
    """

    def __init__(self, tokenizer, lead: str, kind: str, bare: UnitIds | None = None):
        super().__init__()
        self.tokenizer, self.lead, self.kind, self.bare = tokenizer, lead, kind, self if bare is None else bare
        self.model, self.older = tokenizer.model, {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.mark = lead.translate(self.letters)

    def __missing__(self, unit: str) -> bytes:
        out = self.older.get(unit)
        if out is None:
            out = self.fresh(unit)
        if len(unit) <= CACHED_CHARS:
            if len(self) >= MOST_CACHED:
                self.older = dict(self)
                self.clear()
            self[unit] = out
        return out

    def fresh(self, unit: str) -> bytes:
        if unit.isalpha():
            return self.merged(self.mark + unit if unit.isascii() else self.spelled(self.lead + unit))
        if unit[-1:] in MARKS and unit[:-1].isalpha():  # a word and one mark, most of the rest
            return self[unit[:-1]] + self.bare[unit[-1]]
        if self.lead and (not unit or unit[0].isspace()):
            raise NotLone
        if not WORDS_AND_MARKS(unit):
            return self.whole(unit)
        head, *rest = PIECES(unit)
        return self[head] + b"".join(map(self.bare.__getitem__, rest)) if rest else self.whole(unit)

    def spelled(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def merged(self, letters: str) -> bytes:
        """One piece for the tokenizer: straight to its merges."""
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def whole(self, unit: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(self.lead + unit, add_special_tokens=False).ids).tobytes()


class PieceIds(UnitIds):
    """Token bytes by what lies between two ``cuts``, a space before it included."""

    def __init__(self, tokenizer, kind: str):
        super().__init__(tokenizer, "", kind)
        self.space = " ".translate(self.letters)

    def fresh(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " else piece
        if not word.isalpha():
            return self.whole(piece)
        if not piece.isascii():
            return self.merged(self.spelled(piece))
        return self.merged(piece if word is piece else self.space + word)


LATIN, MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"  # letters; ASCII marks but the apostrophe, which may join letters
WORDS_AND_MARKS = re.compile(rf"[{LATIN}{MARK}]+(?:\n[{LATIN}{MARK}]+)*").fullmatch
PIECES = re.compile(rf"[{LATIN}]+|[{MARK}]+|\n").findall
MARKS = frozenset(filter(re.compile(f"[{MARK}]").match, map(chr, range(128))))
_ENCODERS: dict[tuple[str, bool | None], tuple[Callable, str]] = {}  # of this worker


def forget_units() -> None:
    """Drop what this worker has cached of units: the stages behind the tokenizing need the memory, not the units."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()  # the caches hold themselves
        release_unused()


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is one for which units may be encoded apart: bare byte-level pieces and their merges."""
    model, pieces = spec["model"], spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and (pieces.get("type"), pieces.get("add_prefix_space"), pieces.get("use_regex", True)) == ("ByteLevel", False, True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not spec.get("truncation")
        and not spec.get("padding")
    )


def encoder(path: str, as_text: bool = False) -> tuple[Callable[[str], bytes], str]:
    """The ids of a text as bytes, and their numpy type: 16 bits where the vocabulary allows, else 32.

    They are those of the library's ``encode(text, add_special_tokens=False)``. With ``as_text`` the strings of added
    tokens are ordinary text. Files of another kind than ``plain_byte_level``, and texts with the string of an
    added token, are encoded as a whole by the library.
    """
    if (path, as_text) not in _ENCODERS:
        _ENCODERS[path, as_text] = _encoder(path, as_text)
    return _ENCODERS[path, as_text]


def batch_encoder(path: str) -> tuple[Callable[[pa.Array], Iterator[bytes]], str]:
    """As ``encoder``, for a whole Arrow array of texts; null counts as empty."""
    if (path, None) not in _ENCODERS:
        _ENCODERS[path, None] = _batch_encoder(path)
    return _ENCODERS[path, None]


def _opened(path: str, as_text: bool) -> tuple:
    """The tokenizer, array and numpy type of its ids, encoding of whole texts, whether parts may be encoded apart, search for added tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = as_text
    spec = json.loads(tokenizer.to_str())
    largest = max([*tokenizer.get_vocab(with_added_tokens=True).values(), 0])
    kind, dtype = ("H", "<u2") if largest < 1 << 16 else ("I", "<u4")

    def whole(text: str) -> bytes:
        return array(kind, tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    added = spec.get("added_tokens") or []
    apart = plain_byte_level(spec) and not (as_text and not all(t.get("special") for t in added))
    special = None if as_text or not added else re.compile("|".join(re.escape(t["content"]) for t in added)).search
    return tokenizer, kind, dtype, whole, apart, special


def _encoder(path: str, as_text: bool) -> tuple[Callable[[str], bytes], str]:
    tokenizer, kind, dtype, whole, apart, special = _opened(path, as_text)
    if not apart:
        return whole, dtype
    first = UnitIds(tokenizer, "", kind)
    follow = UnitIds(tokenizer, " ", kind, first).__getitem__
    lone = re.compile(r"(?<=\S) (?=\S)").split

    def encode(text: str) -> bytes:
        if special and special(text):
            return whole(text)
        if not text.startswith(" "):
            units = text.split(" ")
            try:
                return first[units[0]] + b"".join(map(follow, units[1:]))
            except NotLone:  # found by the units themselves, so that ordinary texts need no search
                pass
        units = lone(text)
        return first[units[0]] + b"".join(map(follow, units[1:]))

    return encode, dtype


UNSURE, BLANK, SOLID, LETTER, POINT, DIGIT, LATIN_LEAD, SPACE_LEAD = range(8)  # kinds of UTF-8 bytes; the leads only until their character is known
KINDS = np.array([UNSURE] * 128 + [SOLID] * 128, np.uint8)
for _kind, _bytes in (
    (BLANK, b" \t\n\x0b\x0c\r"),
    (SOLID, b"'"),
    (LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (POINT, "".join(MARKS).encode()),
    (DIGIT, b"0123456789"),
    (LATIN_LEAD, bytes(range(0xC3, 0xC9))),  # U+00C0 to U+023F, letters but for two
    (SPACE_LEAD, b"\xc2\xe1\xe2\xe3"),
):
    KINDS[list(_bytes)] = _kind
WIDE_SPACES = np.array([int.from_bytes(c.encode().ljust(3, b"\0")) for c in map(chr, range(128, 1 << 16)) if c.isspace() or c == "\u180e"])


def cuts(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes, ``bounds`` of the texts included, at which a byte-level tokenizer surely parts two pieces.

    It parts Latin letters, ASCII marks and ASCII digits from each other and from white space behind them. The last
    character of white space before anything else begins a piece: a space goes with what follows, others stand alone.
    """
    kind = KINDS[text]
    lead = np.flatnonzero(kind == LATIN_LEAD)
    sign = (text[lead] == 0xC3) & ((text[lead + 1] == 0x97) | (text[lead + 1] == 0xB7))
    kind[lead] = kind[lead + 1] = np.where(sign, SOLID, LETTER)
    lead = np.flatnonzero(kind == SPACE_LEAD)
    code = text[lead].astype(np.int64) << 16 | text[lead + 1].astype(np.int64) << 8
    code |= np.where(text[lead] == 0xC2, 0, text.take(lead + 2, mode="clip"))
    kind[lead] = np.where(np.isin(code, WIDE_SPACES), UNSURE, SOLID)
    cut = np.zeros(len(text) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] >= LETTER) & ((kind[1:] >= LETTER) | (kind[1:] == BLANK))
    last = kind == BLANK
    last[bounds[1:] - 1] = False  # what follows is another text
    last[:-1] &= kind[1:] >= SOLID
    last = np.flatnonzero(last)
    cut[last] = True
    cut[last[text[last] != 32] + 1] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


def _batch_encoder(path: str) -> tuple[Callable[[pa.Array], Iterator[bytes]], str]:
    tokenizer, kind, dtype, whole, apart, special = _opened(path, as_text=False)
    ids_of = PieceIds(tokenizer, kind).__getitem__

    def plain(texts: pa.Array) -> Iterator[bytes]:
        return (whole(t.as_py() or "") for t in texts)

    def encode(texts: pa.Array) -> Iterator[bytes]:
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1)
            yield from chunk(texts, at, ends[at : to + 1])
            at = to

    def chunk(texts: pa.Array, at: int, ends: np.ndarray) -> Iterator[bytes]:
        bounds, size = ends - ends[0], int(ends[-1] - ends[0])
        if not size:
            yield from [b""] * (len(ends) - 1)
            return
        raw = texts.buffers()[2].slice(int(ends[0]), size)
        cut = cuts(np.frombuffer(raw, np.uint8), bounds)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut), raw]).dictionary_encode()
        ids = pa.array(map(ids_of, pieces.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(pieces.indices)
        data, of_text = memoryview(ids.buffers()[2]), np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(cut, bounds)]
        added = special and special(str(raw, "utf-8"))  # in a text, or across two
        for i in range(len(bounds) - 1):
            if added and special(text := texts[at + i].as_py()):
                yield whole(text)
            else:
                yield bytes(data[of_text[i] : of_text[i + 1]])

    return (encode if apart else plain), dtype


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, text hash ``th``, place ``row`` in the input, n_tokens, and the compressed ids with their ``width`` in bytes, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        release_unused()
        (encode, dtype), pack = batch_encoder(path), zstandard.ZstdCompressor(level=1).compress
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        for batch in batches:
            sizes, ids = [], []
            for x in encode(batch.column(3)):
                sizes.append(len(x) // width + 1)
                ids.append(pack(x + end))
            widths = pa.array(np.full(len(ids), width, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), widths, pa.array(ids, pa.binary())], ["doc_id", "th", "row", "n_tokens", "width", "ids"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"), "text")
    return source.mapInArrow(run, "doc_id bigint, th bigint, row bigint, n_tokens bigint, width int, ids binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The arrays of ids of the last two columns, ``width`` and ``ids``."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for width, x in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)):
        yield np.frombuffer(unpack(x.as_py()), f"<u{width}")


def rank_order(ids: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first, ties by id. Rows to the driver: the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in unpacked(batch):
                most = int(x.max(initial=0)) + 1
                if most > len(total):
                    total = np.concatenate([total, np.zeros(max(most, 2 * len(total)) - len(total), np.int64)])
                if len(x) > 4096:
                    seen = np.bincount(x)
                    total[: len(seen)] += seen
                else:
                    np.add.at(total, x, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = ids.select("width", "ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "id").select("id").collect()
    return np.array([r[0] for r in rows], np.uint32)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    codes[: len(ranks)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts, raw = ends - lengths, np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


BLOCK_SCHEMA = "part int, at bigint, doc_ids array<bigint>, counts array<bigint>, control binary, data binary"


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Write the file set of ``docs`` below ``path`` and return ``path``.

    Ranges are cut by doc_id, text and place in the input, so rows repeated in doc_id and text don't crowd one task.
    """
    spark = docs.sparkSession
    ids, ids_path = persisted(tokenized(docs, tokenizer or tokenizer_path(), end_id), "token-ids", compression="none")
    order = rank_order(ids)
    spark.createDataFrame([(order.astype(int).tolist(),)], "ids array<int>").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # four bytes for each id up to the largest

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        part, at, pending, names, ranks = TaskContext.get().partitionId(), 0, 0, [], []

        def block() -> pa.RecordBatch:
            control, data = pack_ranks(np.concatenate(ranks))
            columns = [[part], [at], [names], [[len(x) for x in ranks]], [control], [data]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], BLOCK_NAMES)

        for batch in batches:
            for doc_id, x in zip(batch.column(0), unpacked(batch)):
                names.append(doc_id.as_py())
                ranks.append(shared.value[x])
                pending += len(x)
                if pending >= BLOCK_TOKENS:
                    yield block()
                    at, pending, names, ranks = at + pending, 0, [], []
        if names:
            yield block()

    (
        ids.repartitionByRange("doc_id", "th", "row")
        .sortWithinPartitions("doc_id", "th", "row")
        .select("doc_id", "width", "ids")
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(f"{path}/blocks")
    )
    drop_path(spark, ids_path)
    return path


BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids (32-bit little-endian) of every document in the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    order = spark.read.parquet(f"{path}/ranks").first()["ids"]
    ids_of = spark.sparkContext.broadcast(np.array(order, "<u4"))
    held = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    ends = blocks.groupBy("part").agg(F.max(F.col("at") + held).alias("end")).orderBy("part").collect()  # one row for each file
    before, base = {}, 0
    for row in ends:
        before[row["part"]], base = base, base + row["end"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = ids_of.value[unpack_ranks(row["control"], row["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                texts = [ids[e - n : e].tobytes() for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - counts + row["at"] + before[row["part"]], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(x) for x in texts], pa.int64()),
                        pa.array(texts, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def token_index(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the files of ``docs`` below ``path`` and return their index, read back from the files.

    Without a path they go to a fresh folder below the checkpoint folder; ``files_of`` names it.
    """
    spark = docs.sparkSession
    path = write_files(docs, path or shared_dir(spark, "token-files"), tokenizer)
    return read_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def files_of(index: DataFrame) -> str:
    """The folder of the file set that ``index`` (of ``token_index`` or ``read_files``) was read from."""
    return index.inputFiles()[0].rsplit("/blocks/", 1)[0]


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
