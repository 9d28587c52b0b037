"""The ledger of loads: counts and digest are gathered while the rows are written, in that same job.

A load is known by its source and the digest of its rows, which doesn't depend on their order. Loading the same rows
again overwrites them with the same and adds no second line.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists

SCHEMA = "run_id string, source string, started_at timestamp, duration_ms double, rows_read bigint, rows_loaded bigint, digest string, status string, counts map<string,bigint>"


def observed(rows: DataFrame, counts: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows`` that count themselves on their way: all, those for which each of ``counts`` is true, and two sums of hashes."""
    watch = Observation(f"load-{uuid.uuid4().hex}")
    columns = [F.to_json(F.col(c)) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes]
    hashed = [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]
    sums = [F.sum(h.cast("decimal(20,0)")).alias(f"_h{i}") for i, h in enumerate(hashed)]
    return rows.observe(watch, F.count(F.lit(1)).alias("_n"), *sums, *[F.count_if(test).alias(name) for name, test in counts.items()]), watch


def digest_of(sums: list) -> str:
    """Both sums modulo 2^64 as hexadecimal digits."""
    return "".join(f"{int(s or 0) % (1 << 64):016x}" for s in sums)


def load(rows: DataFrame, path: str, source: str, ledger: str, counts: Mapping[str, Column] | None = None, rows_read: int | None = None) -> DataFrame:
    """Write ``rows`` to ``path`` and note it in the ledger; the ledger's line of this load, new or found there."""
    spark, counts = rows.sparkSession, dict(counts or {})
    began, clock = time.time(), time.perf_counter()
    watched, watch = observed(rows, counts)
    watched.write.mode("overwrite").parquet(path)
    found = watch.get
    digest = digest_of([found["_h0"], found["_h1"]])
    known = lines(spark, ledger).where((F.col("source") == source) & (F.col("digest") == digest))
    if known.isEmpty():
        line = (uuid.uuid4().hex, source, None, round(1000 * (time.perf_counter() - clock), 1), rows_read if rows_read is not None else found["_n"], found["_n"], digest, "ok", {k: found[k] for k in counts})
        spark.createDataFrame([line], SCHEMA).withColumn("started_at", F.timestamp_seconds(F.lit(began))).coalesce(1).write.mode("append").parquet(ledger)
    return lines(spark, ledger).where((F.col("source") == source) & (F.col("digest") == digest))


def lines(spark: SparkSession, ledger: str) -> DataFrame:
    """All lines of a ledger; none if there is no such table yet."""
    return spark.read.schema(SCHEMA).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], SCHEMA)
