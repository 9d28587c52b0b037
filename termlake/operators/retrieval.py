"""Hybrid ranking over a filtered candidate set: Okapi BM25 and cosine, min-max scaled and blended.

Corpus statistics are those of the candidates, so filters come before ranking and may not move past it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..functions.text import content_key, tokenize

K1, B, FLOOR = 1.5, 0.75, 0.25
ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score) of every candidate; a repeated query word counts again, an unknown one adds 0.

    A word in more than half of the candidates has a negative weight, which becomes FLOOR times the mean
    weight of the whole vocabulary; that mean is one row, and so are the candidate count and mean length.
    """
    spark = docs.sparkSession
    tokens = docs.select(F.col(id_col).alias("id"), tokenize(F.coalesce(text_col, F.lit(""))).alias("tokens"))
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(tokenize(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    stats = tokens.agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("avgdl"))
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", (F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    weights = (
        idf.join(F.broadcast(terms), "term")  # the words of one query
        .crossJoin(F.broadcast(mean))
        .select("term", (F.col("times") * F.when(F.col("idf") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("idf"))).alias("weight"))
    )
    wanted = F.broadcast(terms.select(F.collect_set("term").alias("wanted")))
    tf = (
        tokens.crossJoin(wanted)
        .select("id", F.size("tokens").alias("dl"), F.explode(F.filter("tokens", lambda t: F.array_contains("wanted", t))).alias("term"))
        .groupBy("id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = tf.join(F.broadcast(weights), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.sum(F.col("weight") * share).alias("score"))
    return tokens.select("id").join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def minmax(scores: DataFrame, column: str = "score") -> DataFrame:
    """``scores`` with ``norm`` in [0, 1]; all 0 if the range is below 1e-12."""
    bounds = F.broadcast(scores.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))
    span = F.col("_hi") - F.col("_lo")
    return scores.crossJoin(bounds).withColumn("norm", F.when(span < 1e-12, 0.0).otherwise((F.col(column) - F.col("_lo")) / span)).drop("_lo", "_hi")


def cosine_scores(vectors: DataFrame, query: Column, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score"))


def top_k(scores: DataFrame, k: int, column: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(column), "id").limit(k)


def hybrid(lexical: DataFrame, semantic: DataFrame, alphas: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(id, alpha, score): scaled scores are computed once and blended for each alpha."""
    both = minmax(lexical).select("id", F.col("norm").alias("lex")).join(minmax(semantic).select("id", F.col("norm").alias("sem")), "id")
    alpha = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    return both.select("id", "lex", "sem", alpha).select("id", "alpha", (F.col("alpha") * F.col("sem") + (1 - F.col("alpha")) * F.col("lex")).alias("score"))


def embedded(texts: DataFrame, archive: DataFrame) -> DataFrame:
    """``texts`` with the archived vector of their content; ``missing`` tells the texts without one.

    Of a key that the archive has several times the least vector counts; ``merge_archives`` puts archives in order first.
    """
    keyed = texts.withColumn("content_key", content_key(F.col("text")))
    once = archive.groupBy("content_key").agg(F.min("embedding").alias("embedding"))
    return keyed.join(once, "content_key", "left").withColumn("missing", F.col("embedding").isNull())


class MissingVectors(LookupError):
    """Texts without an archived vector; no model is called here."""


def require_embedded(texts: DataFrame, archive: DataFrame) -> DataFrame:
    """As ``embedded``; raises with counts if any text has no vector."""
    out = embedded(texts, archive)
    n, missing = out.agg(F.count("*"), F.count_if("missing")).first()
    if missing:
        raise MissingVectors(f"{missing} of {n} texts have no vector")
    return out.drop("missing")


def merge_archives(archives: list[DataFrame]) -> DataFrame:
    """content_key and embedding of all archives; of keys in several the earliest archive's vector."""
    ranked = [a.select("content_key", "embedding").withColumn("rank", F.lit(i)) for i, a in enumerate(archives)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy("content_key").agg(F.min_by("embedding", "rank").alias("embedding"))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Write an archive as a whole; an explicit job, never part of a lookup."""
    vectors.select("content_key", "embedding").write.mode("overwrite").parquet(path)


def unranked(candidates: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The first candidates by key: what is shown where nothing was asked."""
    return candidates.orderBy(key).limit(limit)


def to_embed(sources: list[DataFrame], most: list[int | None] | None = None) -> DataFrame:
    """One row per distinct content of all sources (text), with the least of its texts; ``most`` cuts the texts of a source."""
    texts = None
    for source, limit in zip(sources, most or [None] * len(sources), strict=True):
        cut = source.select((F.col("text") if limit is None else F.left("text", F.lit(limit))).alias("text"))
        texts = cut if texts is None else texts.unionByName(cut)
    return texts.where("text <> ''").groupBy(content_key(F.col("text")).alias("content_key")).agg(F.min("text").alias("text"), F.count("*").alias("n_sources"))


def summary_line(title: Column, target: Column, acquirer: Column, label: Column, date: Column) -> Column:
    """title, target / acquirer, label and year, the missing ones left out."""
    parties = F.nullif(F.concat_ws(" / ", target, acquirer), F.lit(""))
    return F.concat_ws(" · ", title, parties, label, F.date_format(date, "yyyy"))
