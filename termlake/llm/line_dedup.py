"""Line deduplication over levelled sorted runs of line hashes, built-in functions only.

Documents arrive in batches of ascending doc_id. A run is a table of distinct 128-bit line hashes,
bucketed and sorted by the hash, so that a batch merges with every run without moving the run. A
batch drops lines whose key is in a run or in a smaller document of the batch; its new keys become
a run of level 0. As soon as a level holds ``fanout`` runs they are merged into one of the next level.
Dropped lines are places in their text, taken out by one set difference.

Defined results: a null or empty text is one empty line and keeps an empty text; rows that share a
doc_id are one document; a row with a null doc_id is a document of its own behind all others, in order
of its text's hash (equal texts are one); a line repeated in one document only stays; key equality is
equality of 128 hash bits; a very long text or line is worked on by one task, in time proportional to it; an
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, drop_path, persisted, shared_dir, table

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
HEAVY_PARTS = 256  # a key with more than 1/256 of all rows is heavy, so there are fewer than 256 of them
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs. ``add`` takes one batch of lines (doc, th, at, h1, h2) and returns those it drops, as (doc, th, at)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _write(self, keys: DataFrame, level: int) -> None:
        name, path = f"tl_run_{uuid.uuid4().hex}", shared_dir(self.spark, "line-run")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))  # known before it is written, so that a failure leaves nothing
        (
            keys.select(*KEY)
            .repartition(self.buckets, *KEY)
            .write.format("parquet")
            .option("path", path)
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .saveAsTable(name)
        )

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                runs = self.levels[level]
                merged = self.spark.table(runs[0][0])
                for name, _ in runs[1:]:
                    merged = merged.union(self.spark.table(name))  # runs share no key
                self._write(merged, level + 1)
                self.levels[level] = []
                self._drop(runs)
            level += 1

    def add(self, batch: DataFrame, heavy_above: int) -> DataFrame:
        # The first document with a key: the least id, or else (no id has it) the least text hash.
        firsts = [F.min("doc").alias("first"), F.min(F.when(F.col("doc").isNull(), F.col("th"))).alias("first_th")]
        keys = batch.groupBy(*KEY).agg(*firsts, F.count("*").alias("n"))
        old = F.lit(False)
        for i, (name, _) in enumerate(run for level in self.levels for run in level):
            run = self.spark.table(name).withColumn(f"old_{i}", F.lit(True))
            keys = keys.join(run, KEY, "left")
            old = old | F.coalesce(F.col(f"old_{i}"), F.lit(False))
        keys, path = persisted(keys.select(*KEY, "first", "first_th", "n", old.alias("old")), "line-batch")
        shared = keys.where("old OR n > 1")
        heavy = F.broadcast(shared.where(F.col("n") > heavy_above).drop("n"))
        light = shared.where(F.col("n") <= heavy_above).drop("n")
        hits = batch.join(heavy, KEY).unionByName(batch.join(heavy, KEY, "left_anti").join(light, KEY))
        later = F.when(F.col("doc").isNotNull(), F.col("doc") > F.col("first")).otherwise(F.col("first").isNotNull() | (F.col("th") > F.col("first_th")))
        dropped, _ = persisted(hits.where(F.col("old") | later).select("doc", "th", "at"), "line-dropped")
        self._write(keys.where("NOT old"), 0)
        drop_path(self.spark, path)
        self._compact()
        return dropped

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def line_dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64("text").alias("_th"))
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.select(F.percentile_approx("_doc", shares, 1000).alias("c")).first()["c"] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + F.coalesce(F.col("doc") > cut, F.lit(True)).cast("int")
    key = F.col("key")
    lines, lines_path = persisted(
        docs.select(F.col("_doc").alias("doc"), F.col("_th").alias("th"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("at", "key"))
        .where(F.length(key) >= MIN_CHARS)
        .select("doc", "th", "at", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), number.alias("batch")),
        "line-hashes",
    )
    heavy_above = max(1, lines.count() // HEAVY_PARTS)
    dropped = None
    with LineRuns(spark, fanout) as runs:
        for i in range(len(set(cuts)) + 1):
            part = runs.add(lines.where(F.col("batch") == i).drop("batch"), heavy_above)
            dropped = part if dropped is None else dropped.union(part)
    drop_path(spark, lines_path)
    by_text = dropped.groupBy(F.col("doc").alias("gone_doc"), F.col("th").alias("gone_th")).agg(F.collect_list("at").alias("_gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    return (
        docs.join(by_text, F.col("_doc").eqNullSafe(F.col("gone_doc")) & (F.col("_th") == F.col("gone_th")), "left")
        .select("doc_id", lines_of(F.col("text")).alias("_lines"), "_gone")
        .select("doc_id", "_lines", kept.alias("_kept"))
        .select(
            "doc_id",
            F.size("_lines").cast("bigint").alias("n_lines"),
            (F.size("_lines") - F.size("_kept")).cast("bigint").alias("n_dropped"),
            F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n").alias("kept_text"),
        )
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), m AS (
  SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k
), f AS (
  SELECT l.doc_id, l.i, l.line, m.first IS NOT NULL AND l.doc_id > m.first AS gone FROM l LEFT JOIN m ON m.k = l.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
