"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows of each input partition are counted; exact draws say how many of them go to each shard, so that
shard sizes are exact and the matrix has the law of a uniform random permutation. The matrix is never
held as a whole: it is drawn down a binary tree of partition ranges, each node splitting its rows' shard
counts by a multivariate hypergeometric draw seeded by the node, so each task draws its own row. Each
task then permutes its rows locally and deals them by its row of the matrix; the exchange moves every
row once, to a (shard, cell) of random cell; a second local permutation in each cell gives the slots.

Law ``rows``: shard sizes differ by one at most. Draws are seeded by node and partition, so a task that
runs again deals the same rows alike; a partition that doesn't hold the counted number of rows is an error.

Defined results: null text has no bytes (size 8, crc32 0); rows are dealt one by one whatever they hold,
so equal keys, nulls and repeated rows can't crowd a shard; a very long text is one row of one cell, and
cells are as many as hold CELL_BYTES or CELL_ROWS on average; result columns whose names the table already
has get an underscore more; an empty table gives empty shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

SHARDS = 24
SEED = 20
CELL_ROWS, CELL_BYTES = 2_000_000, 1 << 28  # rows and text bytes of a cell, which one task permutes by a sort that spills
NUMPY_LIMIT = 10**9  # numpy draws hypergeometric numbers from fewer rows


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn from ``good`` and ``bad`` ones are good.

    Beyond numpy's limit by inversion: the chances relative to that of the mode follow from the ratio of
    neighbours, outwards from the mode until they no longer count in 64-bit arithmetic.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad
    mode = min(high, max(low, (sample + 1) * (good + 1) // (n + 2)))
    p = good / n
    reach = int(12 * (sample * p * (1 - p) * (n - sample) / n) ** 0.5) + 64
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) / (up + 1) * ((sample - up) / (bad - sample + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - sample + down) / (sample - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    total = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(total, rng.random() * total[-1], "right"))


def multivariate(rng: np.random.Generator, rooms: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows fall to each shard, of which ``rooms`` rows are to be dealt."""
    if rooms.sum() < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(rooms, sample, method="marginals")
    out, rest = np.zeros_like(rooms), int(rooms.sum())
    for i, room in enumerate(rooms.tolist()):
        rest -= room
        out[i] = hypergeometric(rng, room, rest, sample)
        sample -= int(out[i])
    return out


def matrix_rows(counts: np.ndarray, sizes: np.ndarray, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows ``first`` to ``last - 1`` of the matrix with row sums ``counts`` and column sums ``sizes``."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    nodes = [(0, len(counts), sizes.astype(np.int64))]
    while nodes:
        a, b, rooms = nodes.pop()
        if b <= first or a >= last:
            continue
        if b - a == 1:
            yield a, rooms
            continue
        middle = (a + b) // 2
        left = multivariate(np.random.default_rng([seed, a, b]), rooms, int(sums[middle] - sums[a]))
        nodes += [(middle, b, rooms - left), (a, middle, left)]


def cells_of(row: np.ndarray, cells: int, seed: int, p: int) -> np.ndarray:
    """A partition's rows for each cell: every row of a shard falls to any of its ``cells`` cells alike."""
    return np.random.default_rng([seed, p, 1]).multinomial(row, np.full(cells, 1 / cells))


def shard_sizes(total: int, shards: int, seed: int) -> np.ndarray:
    """Rows of each shard; they differ by one at most."""
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    np.random.default_rng(seed).shuffle(sizes)
    return sizes


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with ``_shard`` and the gapless ``_slot`` in it behind them."""
    spark = docs.sparkSession
    shard_name, slot_name, cell_name, draw_name = fresh(docs.columns, "_shard", "_slot", "_cell", "_draw")
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in docs.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    held = F.lit(0)
    for size in texts:
        held = held + size
    rows = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(held.cast("bigint")).alias("bytes")).collect()  # one row for each partition
    counts = np.zeros(1 + max((r["p"] for r in rows), default=0), np.int64)
    for r in rows:
        counts[r["p"]] = r["n"]
    total = int(counts.sum())
    cells = max(1, -(-total // (shards * CELL_ROWS)), -(-sum(r["bytes"] for r in rows) // (shards * CELL_BYTES)))
    shared = spark.sparkContext.broadcast((counts, shard_sizes(total, shards, seed)))  # eight bytes for each partition and shard

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy()
            if len(p):
                held = np.zeros((shards, cells), np.int64)
                for at, row in matrix_rows(*shared.value, seed, int(p[0]), int(p[-1]) + 1):
                    held += cells_of(row, cells, seed, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards * cells)), pa.array(held.ravel())], ["cell", "n"])

    tasks = min(len(counts), 200)
    per_cell = spark.range(0, len(counts), 1, tasks).mapInArrow(summed, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(shards * cells, np.int64)
    for r in per_cell:  # one number for each cell
        sizes[r["cell"]] = r["n"]
    sizes = sizes.reshape(shards, cells)
    starts = spark.sparkContext.broadcast((np.cumsum(sizes, axis=1) - sizes).ravel())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        counts, sizes = shared.value
        mine = np.zeros(shards * cells, np.int64)
        for _, row in matrix_rows(counts, sizes, seed, p, p + 1):
            mine = cells_of(row, cells, seed, p).ravel()
        rng = np.random.default_rng([seed, p])
        to = np.repeat(np.arange(shards * cells, dtype=np.int32), mine)  # the cuts of the permuted partition
        rng.shuffle(to)
        for batch in batches:
            n = batch.num_rows
            if at + n <= len(to):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + n]), pa.array(rng.random(n))], [*batch.schema.names, cell_name, draw_name])
            at += n
        if at != len(to):
            raise RuntimeError(f"partition {p} held {len(to)} rows when counted and {at} when dealt")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = -1, 0
        for batch in batches:
            cell = batch.column(batch.num_columns - 2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            slots = np.empty(len(cell), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    done = done if cell[a] == last else 0
                    slots[a:b] = starts.value[cell[a]] + done + np.arange(b - a)
                    last, done = cell[a], done + b - a
            columns = [*batch.columns[:-2], pa.array((cell // cells).astype(np.int32)), pa.array(slots)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], shard_name, slot_name])

    fields = docs.schema.fields
    dealt = T.StructType([*fields, T.StructField(cell_name, T.IntegerType()), T.StructField(draw_name, T.DoubleType())])
    slotted = T.StructType([*fields, T.StructField(shard_name, T.IntegerType()), T.StructField(slot_name, T.LongType())])
    return (
        docs.mapInArrow(deal, dealt)
        .repartitionById(shards * cells, F.col(cell_name))  # a task for each cell
        .sortWithinPartitions(cell_name, draw_name)
        .mapInArrow(number, slotted)
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_to_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
