"""Change-guarded batch mutation: the full new state of a table from its old state and a batch.

Plain Parquet has no row updates, so a state is written to a new path. ``updated_at`` moves only for rows
that really change: equal rows, NULLs included, keep theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "updated_at"


def _changed(columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return ~same


def one_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Of the rows of each key the last by ``order``, then by all columns: the same whatever way the batch comes in."""
    last = F.max_by(F.struct(*batch.columns), F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*order, *batch.columns])]))
    return batch.groupBy(*keys).agg(last.alias("_r")).select("_r.*")


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Old rows without a new one stay; new and changed rows get ``stamp``. ``change`` tells insert, update or keep.

    A key that the batch has several times gives one row, see ``one_per_key``.
    """
    stamp = F.current_timestamp() if stamp is None else stamp
    new = one_per_key(new, keys, order)
    values = [c for c in old.columns if c not in keys and c != STAMP]
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.select(*keys, *values).withColumn("_new", F.lit(True)).alias("n")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    joined = o.join(n, match, "full")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(_changed(values), "update").otherwise("keep")
    take = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    moved = F.when(change == "keep", F.col(f"o.{STAMP}")).otherwise(stamp)
    return joined.select(*[take(c) for c in [*keys, *values]], moved.alias(STAMP), change.alias("change"))


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return test


def upsert_and_prune(old: DataFrame, new: DataFrame, keys: list[str], scope: Column, stamp: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """As ``guarded_upsert``; old rows in ``scope`` that the batch no longer has go, others stay. NULL keys are keys."""
    marked = old.withColumn("_scope", F.coalesce(scope, F.lit(False)))
    lost = marked.where("_scope").alias("o").join(new.alias("n"), same_keys("o", "n", keys), "left_anti").select(*keys)
    left = old.alias("o").join(lost.alias("g"), same_keys("o", "g", keys), "left_anti")
    return guarded_upsert(left, new, keys, stamp, order)


def update_only(old: DataFrame, updates: DataFrame, keys: list[str], stamp: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Enrichment: changed values of known keys, never a new row. NULL keys are keys."""
    known = one_per_key(updates, keys, order).alias("n").join(old.alias("o"), same_keys("n", "o", keys))
    values = [F.col(f"n.{c}" if c in updates.columns else f"o.{c}").alias(c) for c in old.columns if c != STAMP]
    return guarded_upsert(old, known.select(*values), keys, stamp)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New keys only; of batch rows with one key the least by all columns."""
    least = new.groupBy(*keys).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    unknown = least.alias("n").join(old.alias("o"), same_keys("n", "o", keys), "left_anti")
    return old.unionByName(unknown.select(*old.columns))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table of decisions or of the run ledger."""
    rows.write.mode("append").parquet(path)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: one aggregate, no sort."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*")
