"""Figures as columns: intervals, rendered counts, bands, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_BANDS = ((200e6, "under_200m"), (1e9, "200m_to_1b"), (10e9, "1b_to_10b"))
LARGEST_BAND = "over_10b"


def size_band(value: Column, bands=SIZE_BANDS, largest: str = LARGEST_BAND) -> Column:
    out = F.when(value.isNull(), "unknown")
    for limit, name in bands:
        out = out.when(value < limit, name)
    return out.otherwise(largest)


def wilson(correct: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval within [0, 1]; (0, 0) for n = 0."""
    p = correct / n
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    low, high = F.greatest(F.lit(0.0), (centre - margin) / scale), F.least(F.lit(1.0), (centre + margin) / scale)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def render(present: Column, answered: Column, selected: Column, threshold: int) -> tuple[Column, Column]:
    """A count below the threshold, a percentage (half to even) from it on; and which of the two it is."""
    of = lambda a, b: F.concat(a.cast("string"), F.lit(" of "), b.cast("string"))
    percent = F.concat(F.bround(100 * present / F.nullif(answered, F.lit(0)), 0).cast("int").cast("string"), F.lit("%"))
    text = F.when(answered == 0, of(F.lit(0), selected)).when(answered < threshold, of(present, answered)).otherwise(percent)
    return text, F.when(answered < threshold, "count").when(answered == 0, "count").otherwise("percentage")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
