"""Mixing sources to target weights by capped water-filling, built-in functions only.

Sources by code point, null last, weigh 5, 2, 1, repeating. They share ``budget`` times all words; a
source stops at ``epochs`` times its own words and its excess goes to the others by weight, until no
source is above its cap. A source's target is whole repetitions of every document plus a seeded
sample for the rest: documents in the order of a seeded digest, up to the one that passes the rest.

Defined results: null text has size 0; null source is a source of its own; a null doc_id counts as the empty
id; rows equal in doc_id and text share one draw, and where the sample ends inside a draw as many of its rows
are taken as fit; a source without words takes nothing; a very long text counts as one document, so a source
may miss its target by half of it; result columns whose names the table already has get an underscore more;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, persisted, table, words_of

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
EPOCHS = 2
SEED = "mix-1"
DIGITS = 3  # hex digits of the draw that number its bucket: 4096 buckets for each source
SALTS = 256  # parts in which the rows of one draw are numbered
MOST_SOURCES = 100_000  # up to so many sources the plan is broadcast (under 20 MB)


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def draw_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def running(df: DataFrame, order: list[Column], label: str, **sums: Column) -> DataFrame:
    """``df`` with the sum over all earlier rows for each of ``sums``; no task orders more than its range of rows."""
    ranged, _ = persisted(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    totals, before = {name: 0 for name in sums}, []
    for r in ranged.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("_part").collect():  # one row for each range
        before.append((r["_part"], *(float(totals[n]) for n in sums)))
        totals = {n: totals[n] + (r[n] or 0) for n in sums}
    schema = ", ".join(["_part int", *[f"_{n} double" for n in sums]])
    starts = F.broadcast(df.sparkSession.createDataFrame(before, schema))
    mine = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(mine), F.lit(0)).alias(n) for n, c in sums.items()])
    return local.join(starts, "_part").select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def water_level(sources: DataFrame, budget: float = BUDGET, epochs: float = EPOCHS) -> float:
    """Words for each unit of weight once no source is above its cap; ``sources`` has source, source_size and weight.

    In the order in which sources reach their caps, the level is the largest one at which a source and all later
    ones share what the earlier ones leave, and none of them is above its cap.
    """
    sums = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if not sums["words"]:
        return 0.0
    cap = (epochs * F.col("source_size")).cast("double")
    reach = (cap / F.col("weight")).alias("reach")
    ordered = running(sources.select("source", "weight", cap.alias("cap"), reach), [F.col("reach"), F.col("source")], "mix-reach", capped=F.col("cap"), closed=F.col("weight"))
    level = (F.lit(float(budget * sums["words"])) - F.col("capped")) / (F.lit(float(sums["weight"])) - F.col("closed"))
    shared = ordered.agg(F.max(F.when(level <= F.col("reach"), level)).alias("level"), F.max("reach").alias("most")).first()
    return shared["most"] if shared["level"] is None else shared["level"]


def mixing_plan(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target, whole repetitions, and how far the sampled one goes: up to the draw ``last``, of which it
    takes ``part`` of its ``copies`` rows.

    ``sized`` has source, size and draw; draws decide by buckets, so that no task orders a whole source, and rows
    with one draw are one row with a count.
    """
    bucket = F.substring("draw", 1, DIGITS)
    counts, _ = persisted(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-counts")
    sources = running(counts.groupBy("source").agg(F.sum("words").alias("source_size")), [F.col("source").asc_nulls_last()], "mix-places", place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources, _ = persisted(sources.select("source", "source_size", weight.alias("weight")), "mix-sources")
    level = water_level(sources, budget, epochs)
    target = F.round(F.least(epochs * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")), 6)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = sources.withColumn("target", target).withColumn("whole", whole.cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        counts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(_small(plan.select("source", "rest")).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .where("before <= rest AND rest < before + words")
        .select("source", "bucket", "before", "rest")
    )
    e, s = edge.alias("e"), sized.withColumn("bucket", bucket).alias("s")
    inside = (
        s.join(_small(e), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.bucket") == F.col("e.bucket")))
        .groupBy("s.source", "e.bucket", "s.draw", "s.size", "e.before", "e.rest")
        .agg(F.count("*").alias("copies"))
    )
    earlier = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(earlier), F.lit(0))
    # A copy is taken while its middle is within the rest.
    fit = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("copies")).otherwise(0))
    last = (
        inside.withColumn("part", F.greatest(F.lit(0), F.least(F.col("copies"), fit)).cast("bigint"))
        .groupBy("source", "bucket")
        .agg(F.max(F.when(F.col("part") > 0, F.struct("draw", "part", "copies"))).alias("edge"))
        .select(
            F.col("source").alias("_source"),
            F.coalesce("edge.draw", "bucket").alias("last"),
            F.coalesce("edge.part", F.lit(0)).alias("part"),
            F.coalesce("edge.copies", F.lit(0)).alias("copies"),
        )
    )
    # Without an edge bucket the sampled repetition takes every document or, with no rest, none.
    return plan.join(_small(last), F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source",
        "source_size",
        "target",
        "whole",
        F.when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("last", F.lit("g"))).alias("last"),
        F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.coalesce("part", F.lit(0))).alias("part"),
        F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.coalesce("copies", F.lit(0))).alias("copies"),
    )


def _small(plan: DataFrame) -> DataFrame:
    """``plan`` has one row for each source: broadcast when the counted sources are few, else joined by shuffle."""
    return F.broadcast(plan) if plan.count() <= MOST_SOURCES else plan


RESULTS = ("_size", "_source_size", "_target", "_repeats")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with ``_size``, ``_source_size``, ``_target`` and its number of ``_repeats``, in this order behind its columns.

    Of rows that share the draw at which a source's sample ends, some are taken once more than others: these rows
    alone are written aside, numbered within random parts, and counted off.
    """
    size, source_size, target, repeats, draw, whole, last, part, copies, theirs, salt, place, own, number, start = fresh(
        docs.columns, *RESULTS, "_draw", "_whole", "_last", "_part", "_copies", "_source", "_salt", "_place", "_own", "_number", "_start"
    )
    sized = docs.select("source", size_of(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    sized, _ = persisted(sized, "mix-sizes")
    plan, _ = persisted(mixing_plan(sized, weights, budget, epochs), "mix-plan")
    split = plan.where("0 < part AND part < copies").count() > 0  # whether a source's sample ends inside a draw
    named = dict(zip(plan.columns, (theirs, source_size, target, whole, last, part, copies)))
    plan = plan.select(*[F.col(c).alias(n) for c, n in named.items()])
    rows = (
        docs.withColumns({size: size_of(F.col("text")), draw: draw_of(F.col("doc_id"), F.col("text"), seed)})
        .join(_small(plan), F.col("source").eqNullSafe(F.col(theirs)), "left")
    )
    out = [*docs.columns, size, source_size, target, repeats]
    inside = F.coalesce((F.col(draw) == F.col(last)) & (F.col(part) < F.col(copies)) & (F.col(part) > 0), F.lit(False))
    taken = (F.col(whole) + (F.col(draw) <= F.col(last)).cast("int")).alias(repeats)
    if not split:
        return rows.select(*docs.columns, size, source_size, target, taken)
    aside, _ = persisted(rows.where(inside).withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")), "mix-split")
    parts = aside.groupBy(F.col(theirs).alias(own), F.col(salt).alias(number)).agg(F.count("*").alias(start))
    before = Window.partitionBy(own).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    numbered = aside.withColumn(place, F.row_number().over(Window.partitionBy(theirs, salt).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))))
    counted = numbered.join(_small(starts), F.col(theirs).eqNullSafe(F.col(own)) & (F.col(salt) == F.col(number)))
    again = counted.select(*docs.columns, size, source_size, target, (F.col(whole) + (F.col(place) + F.col(start) <= F.col(part)).cast("int")).alias(repeats))
    return rows.where(~inside).select(*docs.columns, size, source_size, target, taken).union(again).toDF(*out)


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix repeats it, with the columns of ``docs``."""
    mixed = mix(docs)
    repeats = mixed.columns[-1]
    copy = fresh(mixed.columns, "_copy")[0]
    taken = mixed.where(F.col(repeats) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(repeats)))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_repeats")).cast("bigint").alias("taken"),
        F.col("_repeats").cast("bigint").alias("repeats"),
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [{", ".join(f"{w}.0" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum({EPOCHS} * source_size) OVER w, 0) AS capped, coalesce(sum(weight) OVER (), 0) - coalesce(sum(weight) OVER w, 0) AS open,
         {BUDGET} * sum(source_size) OVER () AS budget
  FROM s WINDOW w AS (ORDER BY {EPOCHS} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT max((budget - capped) / open) AS level FROM o
  WHERE (budget - capped) / open <= {EPOCHS} * source_size / weight
), p AS (
  SELECT source, source_size, round(least(CAST({EPOCHS} * source_size AS DOUBLE), level * weight), 6) AS target FROM s, lev
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0 AS middle
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END AS BIGINT) AS repeats
FROM c
"""
