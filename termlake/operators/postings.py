"""An inverted index for BM25: postings bucketed by term, lengths, and document frequencies by stratum.

A search reads the buckets of its own words only. Statistics are still those of the candidates: their number and mean
length come from the lengths, the frequencies of the asked words from their postings joined with the candidates. The
mean weight of the whole vocabulary, which is needed only where an asked word stands in more than half of the
candidates, is summed up from the frequencies of the strata that the filter takes; a candidate set that isn't a
filter on strata has its frequencies counted from all postings in that case.

Rows with one id are one document; a null text has no words, and a null id is no document. Names of strata may not be
id, dl, term, tf, df or bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.shared import shared_path
from .retrieval import B, FLOOR, K1

BUCKETS = 64


@dataclass
class Postings:
    """``terms``: term, id, tf, dl and bucket; ``lengths``: id, dl and strata; ``frequencies``: strata, term, df and bucket."""

    path: str
    terms: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    strata: list[str]
    buckets: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, id_col: str = "id", text_col: str = "text", strata: tuple[str, ...] = (), buckets: int = BUCKETS, path: str | None = None) -> Postings:
    """Index ``docs`` below ``path``, by default a fresh folder that all executors share."""
    spark, strata = docs.sparkSession, list(strata)
    path = path or shared_path(spark, "postings")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *strata, F.coalesce(text_col, F.lit("")).alias("text"))
    count = F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")).cast("bigint")
    texts.groupBy("id").agg(F.sum(count).alias("dl"), *[F.min(s).alias(s) for s in strata]).write.parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    # Whole texts are moved once, to their id; words are counted where they come to lie.
    by_id = texts.select("id", "text").repartition(F.col("id")).join(lengths.hint("shuffle_hash"), "id")
    words = by_id.select("id", "dl", *strata, F.explode(tokenize(F.col("text"))).alias("term"))
    counted = words.groupBy("id", "term", "dl", *strata).agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl", *strata)
    placed = counted.withColumn("bucket", bucket_of(F.col("term"), buckets))
    # A frequent word's postings are split over files by their size, each sorted by word.
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    terms = spark.read.schema("term string, id {0}, tf bigint, dl bigint{1}, bucket int".format(dict(lengths.dtypes)["id"], "".join(f", `{s}` {dict(lengths.dtypes)[s]}" for s in strata))).parquet(f"{path}/terms")
    frequent = terms.groupBy(*strata, "term", "bucket").agg(F.count("*").alias("df"))
    frequent.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/frequencies")
    frequencies = spark.read.schema(frequent.select(*strata, "term", "df", "bucket").schema).parquet(f"{path}/frequencies")
    return Postings(path, terms.drop(*strata), lengths, frequencies, strata, buckets)


def asked_words(index: Postings, query: str) -> dict[str, tuple[int, int]]:
    """Each word of the query with its bucket and how often it is asked."""
    q = index.lengths.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(tokenize(F.col("q"))).alias("term"))
    rows = q.groupBy("term").agg(F.count("*").alias("times")).select("term", bucket_of(F.col("term"), index.buckets).alias("bucket"), "times").collect()
    return {r["term"]: (r["bucket"], r["times"]) for r in rows}


def weight(docs: int, df: int) -> float:
    return math.log(docs - df + 0.5) - math.log(df + 0.5)


def search(index: Postings, query: str, where: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, score) of every candidate: those that pass ``where``, an SQL test of strata, and stand in ``ids`` (id)."""
    asked = asked_words(index, query)
    candidates = index.lengths.where(where) if where else index.lengths
    if ids is not None:
        candidates = candidates.join(ids.select("id").distinct(), "id", "left_semi")
    narrow = where is not None or ids is not None
    inside = (lambda rows: rows.join(candidates.select("id"), "id", "left_semi")) if narrow else lambda rows: rows
    stats = candidates.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first()
    mine = F.col("bucket").isin(sorted({b for b, _ in asked.values()})) & F.col("term").isin(sorted(asked))
    hits = inside(index.terms.where(mine))
    found = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each asked word
    idf = {term: weight(stats["docs"], df) for term, df in found.items()}
    if any(w < 0 for w in idf.values()):
        floor = FLOOR * mean_weight(index, stats["docs"], where, None if ids is None else inside(index.terms))
        idf = {term: floor if w < 0 else w for term, w in idf.items()}
    spark = index.lengths.sparkSession
    weights = spark.createDataFrame([(term, asked[term][1] * w) for term, w in idf.items()], "term string, weight double")
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"])))
    scores = hits.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(F.col("weight") * share).alias("score"))
    return candidates.select("id").join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def mean_weight(index: Postings, docs: int, where: str | None, postings: DataFrame | None) -> float:
    """Mean weight of all words of the candidates, from the frequencies by stratum or else from their postings."""
    if postings is not None:
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
    else:
        df = (index.frequencies.where(where) if where else index.frequencies).groupBy("term").agg(F.sum("df").alias("df"))
    return df.agg(F.avg(F.log(F.lit(docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean")).first()["mean"]
