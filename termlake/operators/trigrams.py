"""Substring search through an index of trigrams: only texts that have all trigrams of the pattern are read and tested.

Case is folded as ILIKE folds it. The literal stretches of a pattern between its wildcards give the trigrams; a pattern
without a stretch of three characters is tested on all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

BUCKETS = 128
TEXTS = 500  # taken apart at a time
MIX = 0x9E3779B97F4A7C15  # an odd number that spreads trigrams over the upper bits


@dataclass
class Trigrams:
    """``grams``: key, the codes of its trigrams in one bucket, and bucket: a row for each text and bucket."""

    grams: DataFrame
    path: str
    key: str
    column: str
    buckets: int


def codes_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers of 32 bits, in order. Unequal trigrams may share one, as texts are tested in the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    packed = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    return np.unique((packed * np.uint64(MIX)) >> np.uint64(32)).astype(np.int64)


def _bucketed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS):
            held = [codes_of(x) for x in batch.column(1).slice(a, TEXTS).drop_null().to_pylist()]
            rows = a + np.flatnonzero(batch.column(1).slice(a, TEXTS).is_valid().to_numpy(zero_copy_only=False))
            row, code = np.repeat(rows, [len(x) for x in held]), np.concatenate([*held, np.zeros(0, np.int64)])
            if not len(code):
                continue
            bucket = code % buckets
            order = np.lexsort((bucket, row))
            row, code, bucket = row[order], code[order], bucket[order]
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(code)], pa.int32()), pa.array(code.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[begin])), lists, pa.array(bucket[begin], pa.int32())], ["key", "codes", "bucket"])


def build(df: DataFrame, key: str, column: str, buckets: int = BUCKETS) -> Trigrams:
    """The index of a text column: one row for each text and bucket, so that single trigrams are not shuffled. Null texts have none."""
    texts = df.select(F.col(key).alias("key"), F.lower(F.col(column)).alias("text"))
    placed = texts.mapInArrow(lambda batches: _bucketed(batches, buckets), f"key {dict(texts.dtypes)['key']}, codes array<int>, bucket int")
    grams, path = stored(placed.hint("rebalance", "bucket"), "trigrams", "bucket")
    return Trigrams(grams, path, key, column, buckets)


def wanted_codes(index: Trigrams, pattern: str) -> dict[int, list[int]]:
    """By bucket, the codes of the trigrams that a matching text has."""
    stretches = [s for s in re.split(r"\\.|[%_]", pattern, flags=re.DOTALL) if len(s) >= 3]
    lower = index.grams.sparkSession.createDataFrame([(s,) for s in stretches], "s string").select(F.lower("s").alias("s")).collect()
    wanted: dict[int, list[int]] = {}
    for code in sorted({int(c) for r in lower for c in codes_of(r["s"])}):
        wanted.setdefault(code % index.buckets, []).append(code - (1 << 32) * (code >> 31))
    return wanted


def search(df: DataFrame, index: Trigrams, value: str) -> DataFrame:
    """As ``browse.contains``: the rows whose text has ``value``, in which ``%`` and ``_`` are wildcards."""
    matches = F.col(index.column).cast("string").ilike(f"%{value}%")
    wanted = wanted_codes(index, value)
    if not wanted:
        return df.where(matches)
    has = lambda codes: reduce(lambda x, y: x & y, [F.array_contains("codes", c) for c in codes])
    every = reduce(lambda x, y: x | y, [(F.col("bucket") == b) & has(codes) for b, codes in wanted.items()])
    read = index.grams.where(F.col("bucket").isin(sorted(wanted)) & every)
    candidates = read.groupBy("key").agg(F.count_distinct("bucket").alias("n")).where(F.col("n") == len(wanted)).select(F.col("key").alias("_key"))
    return df.join(candidates, F.col(index.key).eqNullSafe(F.col("_key")), "left_semi").where(matches)
