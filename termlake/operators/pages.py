"""Pages of a sorted table at any depth, without sorting it again for each.

``arrange`` deals the rows out by ranges of the order once and numbers them within their range. A page is then found from
the sizes of the ranges: it reads one or two of them and orders only its own rows. ``after`` goes on from a row, wherever
rows were put in or taken out before it.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .browse import checked_limit, known, sort_order

PART, PLACE = "_part", "_place"
PLACES = 1 << 33  # places of a range; Spark numbers rows so


@dataclass
class Arranged:
    """``rows`` with their range and place in it; ``starts``: the ranges' numbers and how many rows lie before each."""

    rows: DataFrame
    path: str
    key: str
    sort: str | None
    direction: str
    parts: list[int]
    starts: list[int]
    lasts: list[tuple]
    total: int

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in (PART, PLACE)]


def arrange(df: DataFrame, key: str, sort: str | None = None, direction: str = "asc", ranges: int | None = None) -> Arranged:
    """Write ``df`` in its total order (that of ``browse.page``)."""
    order = sort_order(df, key, sort, direction)
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    number = F.monotonically_increasing_id()
    numbered = dealt.sortWithinPartitions(*order).withColumn("_number", number)
    placed = numbered.select(*df.columns, (F.col("_number") % PLACES).alias(PLACE), F.floor(F.col("_number") / PLACES).cast("int").alias(PART))
    rows, path = stored(placed, "arranged", PART)
    last = F.max_by(F.struct(known(rows, sort or key).alias("sort"), known(rows, key).alias("key")), PLACE)
    sizes = rows.groupBy(PART).agg(F.count("*").alias("n"), last.alias("last")).orderBy(PART).collect()  # a row for each range
    starts, before = [], 0
    for r in sizes:
        starts.append(before)
        before += r["n"]
    return Arranged(rows, path, key, sort, direction, [r[PART] for r in sizes], starts, [tuple(r["last"]) for r in sizes], before)


def page_at(arranged: Arranged, limit: int = 50, offset: int = 0) -> DataFrame:
    """The rows from ``offset`` on; the number of all rows is ``arranged.total``, also past the end."""
    checked_limit(limit)
    rows, parts, starts = arranged.rows, arranged.parts, arranged.starts
    first, last = bisect_right(starts, offset) - 1, bisect_right(starts, offset + limit - 1) - 1
    if first < 0 or offset >= arranged.total:
        return rows.where("false").select(*arranged.columns)
    wanted = F.lit(False)
    for p, start in zip(parts[first : last + 1], starts[first : last + 1]):
        wanted = wanted | ((F.col(PART) == p) & F.col(PLACE).between(offset - start, offset + limit - 1 - start))
    return rows.where(F.col(PART).isin(parts[first : last + 1]) & wanted).orderBy(PART, PLACE).select(*arranged.columns)


def _behind(column: Column, key: Column, value: Any, key_value: Any, direction: str, by_key: bool) -> Column:
    """Whether a row stands behind the one with these values, as Spark tests it."""
    if by_key:
        return key > F.lit(key_value)
    tie = column.eqNullSafe(F.lit(value)) & (key > F.lit(key_value))
    if direction == "desc":
        return tie | (column.isNotNull() if value is None else F.coalesce(column < F.lit(value), F.lit(False)))
    return tie if value is None else tie | column.isNull() | F.coalesce(column > F.lit(value), F.lit(False))


def _is_behind(row: tuple, value: Any, key_value: Any, direction: str, by_key: bool) -> bool:
    """The same test for values on the driver."""
    other, key = row
    if by_key or other == value:
        return key > key_value
    if direction == "desc":
        return value is None or other is not None and other < value
    return value is not None and (other is None or other > value)


def after(arranged: Arranged, key_value: Any, value: Any = None, limit: int = 50) -> DataFrame:
    """The ``limit`` rows behind the one with this key and sort value; ranges that end before it aren't read."""
    checked_limit(limit)
    by_key = arranged.sort is None
    rows = arranged.rows
    open_parts = [p for p, last in zip(arranged.parts, arranged.lasts) if _is_behind(last, value, key_value, arranged.direction, by_key)]
    test = _behind(known(rows, arranged.sort or arranged.key), known(rows, arranged.key), value, key_value, arranged.direction, by_key)
    # The first of them holds at least one row behind it, so with the ``limit`` next ranges there are enough.
    return rows.where(F.col(PART).isin(open_parts[: limit + 1]) & test).orderBy(PART, PLACE).limit(limit).select(*arranged.columns)
