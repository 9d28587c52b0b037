"""Table browsing: profile, whitelisted filter and sort, pages, CSV export, log search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PAGE = 500
MOST_EXPORT = 50_000
MOST_LINES = 1000


class UnknownColumn(ValueError):
    """A column outside the table; raised before any plan is built."""


def known(df: DataFrame, column: str) -> Column:
    if column not in df.columns:
        raise UnknownColumn(column)
    return F.col(f"`{column}`")


def profile(df: DataFrame) -> DataFrame:
    """column, type, n_rows and n_null of every column, in one pass."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_{i}").alias("n_null")) for i, (c, t) in enumerate(df.dtypes)])
    return one.select("n_rows", F.explode(cells).alias("x")).select("x.column", "x.type", "n_rows", "x.n_null")


def contains(df: DataFrame, column: str, value: str) -> DataFrame:
    """Case-insensitive; ``%`` and ``_`` in ``value`` are wildcards."""
    return df.where(known(df, column).cast("string").ilike(f"%{value}%"))


def checked_limit(limit: int) -> None:
    if not 1 <= limit <= MOST_PAGE:
        raise ValueError(f"limit must be 1 to {MOST_PAGE}")


def sort_order(df: DataFrame, key: str, sort: str | None = None, direction: str = "asc") -> list[Column]:
    """A total order: NULLs last ascending, first descending, ties by key. Anything but "desc" is ascending."""
    if not sort:
        return [known(df, key).asc()]
    c = known(df, sort)
    return [c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last(), known(df, key).asc()]


def page(df: DataFrame, key: str, sort: str | None = None, direction: str = "asc", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in ``sort_order``; for deep ones see ``pages``, which sorts once for all."""
    checked_limit(limit)
    return df.orderBy(*sort_order(df, key, sort, direction)).offset(offset).limit(limit)


def with_total(page: DataFrame, total: DataFrame, always: bool) -> DataFrame:
    """``page`` with the one row of ``total`` beside each row; with ``always``, past the last page one row, NULL but for the total."""
    return total.join(F.broadcast(page), F.lit(True), "left" if always else "inner").select(*page.columns, *total.columns)


def page_of(df: DataFrame, key: str, sort: str | None = None, direction: str = "asc", limit: int = 50, offset: int = 0, always: bool = False) -> DataFrame:
    """A page with the number of all rows of the filtered set beside each row; see ``with_total`` for pages past the end."""
    return with_total(page(df, key, sort, direction, limit, offset), df.agg(F.count("*").alias("total")), always)


def lookup(df: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """One row for each asked key, with ``found``: the row of ``df`` with this key, or NULLs where there is none."""
    wanted = asked.select(F.col(asked.columns[0]).alias("asked")).distinct()
    rows = df.withColumn("found", F.lit(True))
    return wanted.join(rows, F.col("asked") == known(df, key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def iso_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO-8601 text; other columns stay."""
    moment = "yyyy-MM-dd'T'HH:mm:ss"
    forms = {"date": "yyyy-MM-dd", "timestamp": moment, "timestamp_ntz": moment}
    return df.select(*[F.date_format(f"`{c}`", forms[t]).alias(c) if t in forms else F.col(f"`{c}`") for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str, key: str, sort: str | None = None, direction: str = "asc", most: int = MOST_EXPORT) -> bool:
    """Write the ordered rows as CSV with a header, ``most`` at most; returns whether rows were left out."""
    c = known(df, sort or key)
    ordered = df.orderBy(c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last(), known(df, key))
    ordered.limit(most).write.mode("overwrite").csv(path, header=True)
    return not df.offset(most).isEmpty()


def log_search(lines: DataFrame, level: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0, order: str = "line_no", always: bool = False) -> DataFrame:
    """Matching lines, oldest first: level by equality, text case-sensitive in the line's JSON; with the number of all matches.

    See ``with_total`` for pages past the end and for no match at all.
    """
    if not 1 <= limit <= MOST_LINES:
        raise ValueError(f"limit must be 1 to {MOST_LINES}")
    found = lines
    if level:
        found = found.where(F.col("level") == level)
    if text:
        found = found.where(F.contains(F.to_json(F.struct(*lines.columns)), F.lit(text)))
    return with_total(found.orderBy(order).offset(offset).limit(limit), found.agg(F.count("*").alias("total_matched")), always)
