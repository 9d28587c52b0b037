"""A table that batches change in place: rows bucketed by the hash of their keys, of which a merge rewrites only those that change.

A merge reads the buckets that the batch's keys (and the rows in scope) fall into, works out the new rows, writes them
aside, and puts the changed buckets in their place by dynamic partition overwrite; all other files stay as they are.
Every merge is decided by the batch and the state alone, so one that broke off can be run again.

Of batch rows with one key the last by the given order, then by all columns, counts; NULL is a key like others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import dropped, stored
from .upsert import STAMP, guarded_upsert, insert_ignore, one_per_key, same_keys, update_only

BUCKET, BUCKETS = "_bucket", 64


@dataclass(frozen=True)
class StateTable:
    """Where the rows are, what identifies one, their columns, and in how many buckets they lie."""

    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def bucketed(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.bucketed(spark).drop(BUCKET)


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> StateTable:
    """A new table from ``rows``, which have one row for each key and a column ``updated_at``."""
    state = StateTable(path, tuple(keys), rows.schema, buckets)
    rows.withColumn(BUCKET, state.bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
    return state


def merge(state: StateTable, batch: DataFrame, kind: str = "upsert", order: Sequence[str] = (), scope: Column | None = None, stamp: Column | None = None) -> dict[str, int]:
    """Bring ``batch`` into the table; how many rows were inserted, updated, kept and deleted in the buckets read, and how many of those were written.

    ``kind``: "upsert", "update" (known keys only) or "insert" (unknown keys only). With ``scope``, a test of old rows, an
    upsert also deletes the rows in scope that the batch doesn't have.
    """
    spark = batch.sparkSession
    keys = list(state.keys)
    once, batch_path = stored(one_per_key(batch, keys, order).withColumn(BUCKET, state.bucket()), "state-batch")
    wanted = once.select(BUCKET)
    table = state.bucketed(spark)
    if scope is not None:
        wanted = wanted.union(table.where(scope).select(BUCKET))
    touched = [r[BUCKET] for r in wanted.distinct().collect()]  # no more than the table has buckets
    old = table.where(F.col(BUCKET).isin(touched))
    plain, new = old.drop(BUCKET), once.drop(BUCKET)
    if kind == "insert":
        marked = insert_ignore(plain.withColumn("change", F.lit("keep")), new.withColumns({STAMP: F.current_timestamp() if stamp is None else stamp, "change": F.lit("insert")}), keys)
    elif kind == "update":
        marked = update_only(plain, new, keys, stamp)
    else:
        left = plain
        if scope is not None:
            gone = plain.where(scope).alias("o").join(new.alias("n"), same_keys("o", "n", keys), "left_anti").select(*keys)
            left = plain.alias("o").join(gone.alias("g"), same_keys("o", "g", keys), "left_anti")
        marked = guarded_upsert(left, new, keys, stamp)
    result, result_path = stored(marked.withColumn(BUCKET, state.bucket()), "state-result", BUCKET)

    counts = result.groupBy(BUCKET).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("insert", "update", "keep")])
    both = old.groupBy(BUCKET).agg(F.count("*").alias("before")).join(counts, BUCKET, "full").na.fill(0)
    deleted = F.col("before") - F.col("update") - F.col("keep")
    by_bucket = both.withColumn("delete", deleted).where("insert + update + keep + delete > 0").collect()  # a row for each bucket
    changed = [r for r in by_bucket if r["insert"] or r["update"] or r["delete"]]
    full = [r[BUCKET] for r in changed if r["insert"] or r["update"] or r["keep"]]
    if full:
        rows = result.where(F.col(BUCKET).isin(full)).select(*table.columns)
        rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(state.path)
    for r in changed:
        if r[BUCKET] not in full:  # its last row went
            dropped(spark, f"{state.path}/{BUCKET}={r[BUCKET]}")
    for path in (batch_path, result_path):
        dropped(spark, path)
    return {c: sum(r[c] for r in by_bucket) for c in ("insert", "update", "keep", "delete")} | {"buckets_read": len(touched), "buckets_written": len(changed)}
