"""Centroid clustering in exact integers, screened in single precision.

Components x become the integers floor(SCALE * x). A round sends every vector to its nearest centroid (squared
Euclidean distance, ties to the lowest number) and replaces each centroid that got vectors by their exact
componentwise floor(sum / count). Distances are screened by one single-precision matrix product for a block of
vectors; an interval that is sure to hold the exact value stands around each result, and only centroids whose
interval reaches the lowest upper end are computed again, in integers.

The interval. Wanted is |c|^2 - 2 v.c, as |v|^2 is the same for all centroids. Let u = 2^-24. Integers round to
single precision with a relative error of u at most, and a sum of n products, added in any order, fused or not, is
off by n u / (1 - n u) times the sum of |v_i c_i| at most; products of integers cannot underflow, and at the sizes
allowed here they cannot overflow. So the computed product is off by (n + 4) u / (1 - (n + 4) u) times |v| |c| at
most, by Cauchy's inequality. |v| and |c| come from exact integer squares. What double precision adds is below
2^-40 of the terms, and that is added to the interval as well.

A component of more than LARGEST in size could leave 64-bit distances; rows and centroids with one are computed in
Python's integers from the start.

Defined results: only vectors with exactly ``size`` components, none null, NaN or infinite, are kept, others have no
row; with fewer kept vectors than centroids there are as many centroids as vectors; repeated rows are vectors of
their own; rows with equal vec_id start in the order of their components, a null vec_id counts as the empty text in
the start order; equal start vectors are centroids of their own, of which the lower number gets all; a distance or
sum beyond 64 bits is null; an empty table gives an empty result; columns other than vec_id and embedding are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, table

SIZE, SCALE = 64, 1024
CLUSTERS, ROUNDS, START = 8, 10, "3:"
LARGEST = 1 << 26  # 64 squared differences of such components stay below 2^61
BLOCK = 4096  # vectors of one matrix product
LIMB = 32  # sums travel as digits of so many bits, each summed by Spark in 64 bits
UNIT = 2.0**-24

Centroids = list[list[int]]


def kept_vectors(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and embedding of the vectors with ``size`` finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = dict(vectors.dtypes)["embedding"]
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", embedding.alias("embedding")).where((F.size("embedding") == size) & finite)


def integers(column: pa.Array, size: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of a column of vectors as 64-bit integers, and which rows need Python's integers (zeros here)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    wide = (np.abs(q) > LARGEST).any(1)
    return np.where(wide[:, None], 0, q).astype(np.int64), wide


def exact_integers(vector: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) without a limit of size: from 2^52 on every x is an integer."""
    return [int(x) * scale if abs(x) >= 2**52 else int(np.floor(x * scale)) for x in vector]


def screened(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be nearest to each row of ``q``; a centroid left out is surely farther."""
    n = q.shape[1] + 4
    product = (q.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids * centroids).sum(1).astype(np.float64)
    norms = np.sqrt((q * q).sum(1).astype(np.float64))
    middle = squares - 2 * product
    off = 2 * n * UNIT / (1 - n * UNIT) * norms[:, None] * np.sqrt(squares) * (1 + 2.0**-20) + 2.0**-40 * (squares + 2 * np.abs(product))
    return middle - off <= (middle + off).min(1, keepdims=True)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid of each row, of equally near ones the lowest number."""
    may = screened(q, centroids)
    best = may.argmax(1)
    open_rows = np.flatnonzero(may.sum(1) > 1)
    if len(open_rows):
        row, c = np.nonzero(may[open_rows])
        far = np.full((len(open_rows), len(centroids)), np.iinfo(np.int64).max)
        far[row, c] = ((q[open_rows[row]] - centroids[c]) ** 2).sum(1)
        best[open_rows] = far.argmin(1)
    return best, ((q - centroids[best]) ** 2).sum(1)


def nearest_wide(vector: list[int], centroids: Centroids) -> tuple[int, int]:
    distance, number = min((sum((a - b) ** 2 for a, b in zip(vector, c)), k) for k, c in enumerate(centroids))
    return number, distance


def assigned_batches(batches: Iterator[pa.RecordBatch], centroids: Centroids, size: int) -> Iterator[tuple]:
    """For blocks of vectors: ids, integers, clusters, distances (in 64 bits), and (row, vector, cluster, distance) of the wide rows."""
    small = all(abs(x) <= LARGEST for c in centroids for x in c)
    c = np.array(centroids, np.int64) if small else None
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            ids, column = batch.column(0).slice(at, BLOCK), batch.column(1).slice(at, BLOCK)
            q, wide = integers(column, size)
            if small:
                best, distance = nearest(q, c)
            else:
                wide[:] = True
                best, distance = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            large = []
            for row in np.flatnonzero(wide):
                vector = exact_integers(column[int(row)].as_py())
                large.append((int(row), vector, *nearest_wide(vector, centroids)))
            for row, _, number, _ in large:
                best[row] = number
            yield ids, q, best, distance, wide, large


def limbs(value: int) -> list[int]:
    """Digits of ``value`` in base 2^LIMB, the last one signed."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def gathered(vectors: DataFrame, centroids: Centroids, size: int) -> dict[tuple[int, int], int]:
    """Exact sums over each cluster: at (cluster, i) of component i, at (cluster, size) of rows, at (cluster, size + 1) of distances.

    Each task gives its own sums, Spark adds them, and the driver gets one row for each cluster, component and digit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (size + 2) for _ in centroids]
        for _, q, best, distance, wide, large in assigned_batches(batches, centroids, size):
            for k in np.unique(best[~wide]):
                mine = (best == k) & ~wide
                for i, s in enumerate([*q[mine].sum(0), mine.sum(), sum(distance[mine].tolist())]):
                    sums[k][i] += int(s)
            for _, vector, k, far in large:
                for i, s in enumerate([*vector, 1, far]):
                    sums[k][i] += s
        rows = [(k, i, at, digit) for k, mine in enumerate(sums) if mine[size] for i, s in enumerate(mine) for at, digit in enumerate(limbs(s))]
        names = ["cluster", "item", "limb", "digit"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    parts = vectors.select("vec_id", "embedding").mapInArrow(run, "cluster int, item int, limb int, digit bigint")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "item", "limb").agg(F.sum("digit").alias("digit")).collect():
        at = r["cluster"], r["item"]
        total[at] = total.get(at, 0) + (r["digit"] << LIMB * r["limb"])
    return total


def start(vectors: DataFrame, clusters: int = CLUSTERS, salt: str = START) -> Centroids:
    """The vectors with the least hashes of their ids, as integers."""
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [exact_integers(r["embedding"]) for r in vectors.orderBy(order, "embedding").select("embedding").limit(clusters).collect()]


def trained(vectors: DataFrame, centroids: Centroids, rounds: int = ROUNDS, size: int = SIZE) -> Centroids:
    for _ in range(rounds):
        sums = gathered(vectors, centroids, size)
        centroids = [[sums[k, i] // sums[k, size] for i in range(size)] if (k, size) in sums else c for k, c in enumerate(centroids)]
    return centroids


def in_long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, Centroids]:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector, and the final centroids.

    The kept vectors are written once and read in every round; no row is shuffled.
    """
    kept, _ = persisted(kept_vectors(vectors, size), "vectors")
    centroids = trained(kept, start(kept, clusters), rounds, size)
    sums = gathered(kept, centroids, size)
    inertia = [sums.get((k, size + 1), 0) for k in range(len(centroids))]
    told = [in_long(x) for x in inertia]
    whole = in_long(sum(inertia))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, best, distance, wide, large in assigned_batches(batches, centroids, size):
            far = distance.astype(object)
            for row, _, _, d in large:
                far[row] = in_long(d)
            columns = [
                ids, pa.array(best, pa.int32()), pa.array(far if len(large) else distance, pa.int64()), pa.array([told[k] for k in best], pa.int64()),
                pa.array([whole] * len(best), pa.int64()), pa.array([digests[k] for k in best], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    kind = dict(kept.dtypes)["vec_id"]
    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))[0]


_DISTANCE = f"CAST(list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS BIGINT)"


def _round_sql(n: int) -> str:
    """One assignment ``a<n>`` to the centroids ``c<n - 1>``, and the centroids ``c<n>`` after it."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, q, near.k AS k, near.d AS d FROM (SELECT vec_id, q, min(struct_pack(d := {_DISTANCE}, k := k)) AS near FROM v, c{n - 1} GROUP BY vec_id, q)
), s{n} AS MATERIALIZED (
  SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, {SIZE + 1})) AS i, unnest(q) AS x FROM a{n}) GROUP BY k, i
), c{n} AS MATERIALIZED (
  SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n - 1} c
  LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY k) m ON m.k = c.k
)"""


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c FROM (SELECT sha256('{START}' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h LIMIT {CLUSTERS})
), {",".join(_round_sql(n) for n in range(1, ROUNDS + 2))}
SELECT vec_id, CAST(a.k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS + 1} a JOIN c{ROUNDS} c ON c.k = a.k
"""
