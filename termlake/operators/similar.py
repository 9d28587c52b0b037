"""Similarity search by cosine: an inverted file of seeded centroids, probed lists, exact ranking.

``build`` puts every vector on the list of its nearest centroid and writes the lists as partitions of one table.
``search`` takes a stated set of asked vectors, block by block: each task scores its rows of the probed lists against
the asked vectors by matrix products of SCORES cells and passes on each batch's best ``most`` for each of them. Nothing but those is shuffled,
lists that no asked vector probes are not read, and no pair is made into a row.

With a number of ``probes`` the search may miss; ``probes_for`` measures how many a wanted recall takes. Without it
the search is exact: after the nearest lists it goes on to every list that can still hold a better row. By the
triangle inequality of angles no row of a list is nearer than the centroid's angle less the list's widest angle.

Similarities are double precision and rank rounded to RANK_DIGITS, ties by code. A zero vector has similarity 0.
Vectors that are null, of another dimension or not finite are not indexed, and asked ones of that kind find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

FIT_ROWS = 20_000  # vectors that centroids are fitted on, at most
MOST_LISTS = 4096
FIT_ROUNDS, SEED = 6, 17
FIRST_PROBES = 8  # of an exact search, before the bound is known
BLOCK_BYTES = 1 << 24  # asked vectors held by a task at a time
SCORES = 1 << 20  # similarities, and best rows not yet ranked, held by a task at a time
RANK_DIGITS = 9
SLACK = 1e-6  # in radians; what rounding can move an angle


@dataclass
class SimilarIndex:
    """``rows``: code, vector and list, stored by list; ``centroids``: unit vectors; ``widest``: largest angle of each list's rows."""

    rows: DataFrame
    path: str
    centroids: np.ndarray
    widest: np.ndarray


def usable(vector: Column, size: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def units(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    largest = np.abs(x).max(1, keepdims=True, initial=0)
    x = np.divide(x, largest, out=np.zeros_like(x), where=largest > 0)  # so that no square overflows
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fitted(x: np.ndarray, lists: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors: the first ``lists`` rows, moved to the mean direction of their rows."""
    centroids = x[:lists].copy()
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(1)
        for k in range(len(centroids)):
            mean = x[nearest == k].sum(0)
            if np.linalg.norm(mean) > 0:
                centroids[k] = mean / np.linalg.norm(mean)
    return centroids


def build(vectors: DataFrame, lists: int | None = None, code: str = "code", vector: str = "embedding") -> SimilarIndex:
    """The index of (code, vector); by default about as many lists as the square root of the rows, MOST_LISTS at most.

    Centroids are fitted on FIT_ROWS vectors with the least seeded hashes; every vector is indexed.
    """
    rows = vectors.select(F.col(code).alias("code"), F.col(vector).alias("vector"))
    one = rows.where(F.size("vector") > 0).select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    size = one["n"] if one else 1
    rows = rows.where(usable(F.col("vector"), size))
    n = rows.count()
    draw = F.xxhash64("code", F.lit(SEED))
    share = F.pmod(draw, F.lit(1 << 40)) < 2.0 * FIT_ROWS / max(1, n) * (1 << 40)
    sample = rows.where(share).orderBy(draw, "code").select("vector").limit(FIT_ROWS).toArrow()
    x = units(sample.column(0).combine_chunks(), size) if sample.num_rows else np.zeros((0, size))
    x = x[np.abs(x).sum(1) > 0]
    centroids = fitted(x, min(lists or max(1, math.isqrt(n)), MOST_LISTS)) if len(x) else np.zeros((1, size))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column(1), size)
            best, angle = np.zeros(len(x), np.int64), np.zeros(len(x))
            step = max(1, SCORES // len(centroids))
            for a in range(0, len(x), step):
                near = x[a : a + step] @ centroids.T
                best[a : a + step], angle[a : a + step] = near.argmax(1), np.arccos(np.clip(near.max(1), -1, 1))
            angle[np.abs(x).max(1) == 0] = np.pi  # no direction: its list is never ruled out
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(best, pa.int32())], ["code", "vector", "angle", "list"])

    kinds = dict(rows.dtypes)
    assigned = rows.mapInArrow(placed, f"code {kinds['code']}, vector {kinds['vector']}, angle double, list int")
    table, path = stored(assigned.hint("rebalance", "list"), "similar-index", "list")  # large lists are split, small ones share tasks
    widest = np.zeros(len(centroids))
    for r in table.groupBy("list").agg(F.max("angle").alias("angle")).collect():  # a row for each list
        widest[r["list"]] = r["angle"]
    return SimilarIndex(table.select("code", "vector", "list"), path, centroids, widest)


def _leading(number: np.ndarray, place: np.ndarray, similarity: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each number the ``most`` best rows, and all that are as good as the last of them, so ties are decided later."""
    order = np.lexsort((-similarity, number))
    number, place, similarity = number[order], place[order], similarity[order]
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    held = np.diff(np.r_[first, len(number)])
    last = np.repeat(similarity[first + np.minimum(held, most) - 1], held)
    keep = similarity >= last
    return number[keep], place[keep], similarity[keep]


def _best(index: SimilarIndex, asked: np.ndarray, wanted: np.ndarray, most: int) -> DataFrame:
    """(number of the asked vector, code, similarity): of each batch of a task its ``most`` best rows of the lists ``wanted`` (asked x lists)."""
    size = index.centroids.shape[1]
    kind = dict(index.rows.dtypes)["code"]
    probed = np.flatnonzero(wanted.any(0)).tolist()
    packed, n_asked = np.packbits(wanted, axis=0), len(asked)

    def scored(x: np.ndarray, who: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        """The best of ``rows`` for the asked ``who``, SCORES similarities at a time."""
        step = max(1, SCORES // len(rows))
        for a in range(0, len(who), step):
            some = who[a : a + step]
            near = np.round(asked[some] @ x[rows].T, RANK_DIGITS)
            if len(rows) > most:
                last = np.partition(near, len(rows) - most, 1)[:, len(rows) - most, None]
                i, j = np.nonzero(near >= last)
            else:
                i, j = np.nonzero(np.ones_like(near, bool))
            yield some[i], rows[j], near[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_numpy(zero_copy_only=False)
            x = units(batch.column(1), size)
            held, pending, ranked = [], 0, 0
            for k in np.unique(lists):
                who = np.flatnonzero(np.unpackbits(packed[:, k], count=n_asked))
                for rows in np.array_split(np.flatnonzero(lists == k), -(-np.count_nonzero(lists == k) // SCORES)):
                    for found in scored(x, who, rows):
                        held.append(found)
                        pending += len(found[0])
                        if pending > 2 * max(SCORES, ranked):
                            held = [_leading(*map(np.concatenate, zip(*held)), most)]
                            pending = ranked = len(held[0][0])
            if pending:
                number, place, similarity = _leading(*map(np.concatenate, zip(*held)), most)
                for a in range(0, len(number), SCORES):
                    part = slice(a, a + SCORES)
                    yield pa.RecordBatch.from_arrays([pa.array(number[part], pa.int32()), batch.column(0).take(pa.array(place[part])), pa.array(similarity[part])], ["asked", "code", "similarity"])

    return index.rows.where(F.col("list").isin(probed)).mapInArrow(run, f"asked int, code {kind}, similarity double")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("asked").orderBy(F.desc("similarity"), "code")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _nearest_lists(index: SimilarIndex, asked: np.ndarray, probes: int) -> np.ndarray:
    order = np.argsort(-(asked @ index.centroids.T), 1, kind="stable")[:, :probes]
    wanted = np.zeros((len(asked), len(index.centroids)), bool)
    np.put_along_axis(wanted, order, True, 1)
    return wanted


def _search_block(index: SimilarIndex, asked: np.ndarray, most: int, probes: int | None) -> DataFrame:
    wanted = _nearest_lists(index, asked, probes or FIRST_PROBES)
    first = _ranked(_best(index, asked, wanted, most), most)
    if probes:
        return first
    first, _ = stored(first, "similar-first")
    bound = np.full(len(asked), -1.0)  # similarity that a further row must reach
    for r in first.where(F.col("rank") == most).select("asked", "similarity").collect():  # a row for each asked vector of the block
        bound[r["asked"]] = r["similarity"]
    to_list = np.arccos(np.clip(asked @ index.centroids.T, -1, 1)) - index.widest
    to_list[np.abs(asked).sum(1) == 0] = -np.pi
    further = ~wanted & (to_list <= np.arccos(np.clip(bound, -1, 1))[:, None] + SLACK)
    if not further.any():
        return first
    return _ranked(first.drop("rank").unionByName(_best(index, asked, further, most)), most)


def search(index: SimilarIndex, asked: DataFrame, most: int = 8, probes: int | None = None) -> DataFrame:
    """(raw, code, similarity, rank): the ``most`` most similar codes of each asked (raw, vector); exact unless ``probes`` is given.

    The asked set is cut into blocks of BLOCK_BYTES, each a pass over the lists it needs. One row of a repeated raw counts.
    """
    size = index.centroids.shape[1]
    once = asked.where(usable(F.col("vector"), size)).groupBy("raw").agg(F.min("vector").alias("vector"))
    once, _ = stored(once, "similar-asked")
    blocks = max(1, -(-once.count() * size * 8 // BLOCK_BYTES))
    spark, kind, out = asked.sparkSession, dict(asked.dtypes)["raw"], None
    for block in range(blocks):
        some = once.where(F.pmod(F.xxhash64("raw"), F.lit(blocks)) == block).toArrow()
        vectors = units(some.column("vector").combine_chunks(), size) if some.num_rows else np.zeros((0, size))
        raws = spark.createDataFrame(pa.table({"asked": pa.array(range(some.num_rows), pa.int32()), "raw": some.column("raw")}), f"asked int, raw {kind}")
        found = _search_block(index, vectors, most, probes).join(raws, "asked").select("raw", "code", "similarity", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the rows of ``truth`` (raw, code) that ``found`` has."""
    total = truth.count()
    return truth.join(found.select("raw", "code"), ["raw", "code"], "left_semi").count() / total if total else 1.0


def probes_for(index: SimilarIndex, asked: DataFrame, wanted: float = 0.95, most: int = 8) -> int:
    """The least power of two of probes, all lists at most, at which ``asked`` reaches the ``wanted`` recall against the exact search."""
    truth, _ = stored(search(index, asked, most), "similar-truth")
    probes = 1
    while probes < len(index.centroids) and recall(search(index, asked, most, probes), truth) < wanted:
        probes *= 2
    return min(probes, len(index.centroids))
