"""Which of many quotes stand in which texts: winnowed fingerprints meet in a hash join, then whole quotes are verified.

A text's fingerprints are the smallest hash of each run of RUN windows of GRAM bytes, so every stretch of LEAST bytes or
more has all fingerprints of its own among those of the text around it. A quote that long is met by the one of its
fingerprints that fewest texts have, and not at all if some text-wide one is missing. A shorter quote is met by the
hash of all its bytes at any place. A bitmap of fixed size, made of the quotes' fingerprints, keeps what cannot meet
inside the task that read the text. Work is linear in the texts; candidates are verified, so results are exact.

Null texts and quotes match nothing, the empty quote every text. Repeated rows of texts and quotes each give their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored

GRAM, RUN = 16, 17
LEAST = GRAM + RUN - 1  # bytes from which a quote is met by winnowing
BITS = 23  # the bitmap has 2^BITS bits, 1 MB
PORTION = 1 << 20  # bytes hashed at a time; a longer text is taken alone
EMPTY = 0

BASE = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes in a row: a polynomial put together from powers of two of its length."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    block, have, out, done = BYTES[raw], 1, None, 0
    n = len(raw) - size + 1
    while True:
        if size & have:  # the next ``have`` bytes of every window
            part = block[done : done + n]
            out = part if out is None else out * np.uint64(pow(int(BASE), have, 1 << 64)) + part
            done += have
        if 2 * have > size:
            return mixed(out + np.uint64(size))
        block = block[: len(block) - have] * np.uint64(pow(int(BASE), have, 1 << 64)) + block[have:]
        have *= 2


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """The smallest of each RUN hashes in a row."""
    if len(hashes) < RUN:
        return np.zeros(0, np.uint64)
    low, have = hashes, 1
    while 2 * have <= RUN:
        low, have = np.minimum(low[: len(low) - have], low[have:]), 2 * have
    n = len(hashes) - RUN + 1
    return np.minimum(low[:n], low[RUN - have : RUN - have + n])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_prints(column: pa.Array, sizes: list[int], whole: bool, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint), each once: winnowed ones, if ``whole``, and those of all windows of ``sizes`` bytes, as far as ``bitmap`` has them."""
    raw, offsets = _bytes(column)
    rows, prints = [], []
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PORTION, "right")) - 1)
        part, starts, ends = raw[offsets[first] : offsets[last]], offsets[first:last] - offsets[first], offsets[first + 1 : last + 1] - offsets[first]
        owner = np.repeat(np.arange(first, last), ends - starts)
        room = np.repeat(ends, ends - starts) - np.arange(len(part))  # bytes of the text from here on
        for size in [*sizes, *([LEAST] if whole else [])]:
            x = winnowed(window_hashes(part, GRAM)) if size == LEAST else window_hashes(part, size)
            ok = room[: len(x)] >= size
            if bitmap is not None:
                ok &= bitmap[x >> np.uint64(64 - BITS)]
            at = np.flatnonzero(ok)
            if len(at):
                pair = np.unique(np.stack([owner[at].astype(np.uint64), x[at]], 1), axis=0)
                rows.append(pair[:, 0].astype(np.int64)), prints.append(pair[:, 1])
        first = last
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(prints)


def quote_prints(quotes: DataFrame) -> DataFrame:
    """(quote, n_bytes, print): all fingerprints of a long quote, one of a short one, EMPTY for the empty one. Null quotes have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quote, size = batch.column(0), batch.column(1).to_numpy()
            rows, prints = [np.flatnonzero(size == 0)], [np.full((size == 0).sum(), EMPTY, np.uint64)]
            for n in np.unique(np.minimum(size, LEAST)):
                mine = np.flatnonzero(np.minimum(size, LEAST) == n)
                if n:
                    at, x = text_prints(quote.take(pa.array(mine)), [] if n == LEAST else [int(n)], n == LEAST, None)
                    rows.append(mine[at]), prints.append(x)
            rows, prints = np.concatenate(rows), np.concatenate(prints)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([quote.take(at), batch.column(1).take(at), pa.array(prints.view(np.int64))], ["quote", "n_bytes", "print"])

    once = quotes.where("quote IS NOT NULL").select("quote").distinct()
    return once.select("quote", F.octet_length("quote").alias("n_bytes")).mapInArrow(run, "quote string, n_bytes int, print bigint")


def locate_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id, span_start, span_end) of the first place of each quote (item_id, quote) in each text (doc_id, text) that holds it."""
    spark = texts.sparkSession
    asked, asked_path = stored(quote_prints(quotes), "quote-prints")
    lengths = [r["n"] for r in asked.select(F.least("n_bytes", F.lit(LEAST)).alias("n")).distinct().collect()]  # LEAST + 1 at most
    sizes, whole, empty = sorted(n for n in lengths if 0 < n < LEAST), LEAST in lengths, 0 in lengths
    bit = F.shiftrightunsigned("print", 64 - BITS)
    bitmap = np.zeros(1 << BITS, bool)
    bits = asked.where("n_bytes > 0").select(bit.cast("int").alias("bit")).distinct().toArrow()  # as many as the bitmap has, at most
    bitmap[bits.column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            rows, prints = text_prints(batch.column(2), sizes, whole, known)
            if empty:
                rows, prints = np.concatenate([rows, np.arange(batch.num_rows)]), np.concatenate([prints, np.full(batch.num_rows, EMPTY, np.uint64)])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(prints.view(np.int64))], ["doc_id", "th", "print"])

    keyed = texts.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = dict(texts.dtypes)["doc_id"]
    seen, seen_path = stored(keyed.mapInArrow(run, f"doc_id {kind}, th bigint, print bigint").distinct(), "text-prints")
    held = seen.groupBy("print").agg(F.count("*").alias("texts"))
    met = asked.join(held, "print", "left").groupBy("quote").agg(F.count_if(F.col("texts").isNull()).alias("missing"), F.min_by("print", F.struct("texts", "print")).alias("print"))
    pairs = met.where("missing = 0").select("quote", "print").join(seen, "print").select("quote", F.col("doc_id").alias("_doc"), F.col("th").alias("_th"))
    candidates, _ = stored(pairs, "quote-candidates")
    for path in (asked_path, seen_path):
        dropped(spark, path)
    found = keyed.join(candidates, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).withColumn("at", F.expr("position(quote, text)")).where("at > 0")
    start = (F.col("at") - 1).cast("int")
    return found.join(quotes, "quote").select("doc_id", "item_id", start.alias("span_start"), (start + F.length("quote")).cast("int").alias("span_end"))
