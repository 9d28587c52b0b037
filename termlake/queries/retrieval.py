"""Tokens, BM25, cosine, scaling and blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_key, tokenize
from ..operators import postings
from ..operators import retrieval as r
from ..sources import tables as t
from .product import bm25_sql

QUERIES, ORACLES = {}, {}
ASKED = "the of machine tion 1996 the"


def register(name: str, sql: str | None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def docs(spark, sf_dir):
    """The candidate set: English documents of one source family, filtered before any statistic."""
    return t.load(spark, sf_dir, "documents").where("lang = 'en' AND source <> 'src0'").select(F.col("doc_id").alias("id"), "text")


CAND = "WITH cand AS (SELECT doc_id AS id, text FROM documents WHERE lang = 'en' AND source <> 'src0')"
SCALE = "CASE WHEN max(score) OVER () - min(score) OVER () < 1e-12 THEN 0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"
COSINE = """cs AS (SELECT e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings e)"""


@register("tokenize", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS tokens_md5 FROM documents")
def tokens(spark, sf_dir):
    w = tokenize(F.col("text"))
    return t.load(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@register("bm25_topk", CAND + bm25_sql("cand", ASKED) + " SELECT id, round(score, 6) AS score FROM scores ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return r.top_k(r.bm25(docs(spark, sf_dir), ASKED).withColumn("score", F.round("score", 6)), 20)


@register("bm25_postings", CAND + bm25_sql("cand", ASKED) + " SELECT id, round(score, 6) AS score FROM scores ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25_postings(spark, sf_dir):
    """As bm25_topk, from an index of all documents; the filter is one on strata."""
    index = postings.build(t.load(spark, sf_dir, "documents"), "doc_id", strata=("lang", "source"))
    return r.top_k(postings.search(index, ASKED, "lang = 'en' AND source <> 'src0'").withColumn("score", F.round("score", 6)), 20)


def cosine_of_first(spark, sf_dir):
    e = t.load(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("query"))  # one row
    return r.cosine_scores(e.crossJoin(F.broadcast(query)), F.col("query"), "vec_id", "embedding")


@register("cosine_topk", f"WITH {COSINE} SELECT id, round(score, 6) AS score FROM cs ORDER BY round(score, 6) DESC, id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return r.top_k(cosine_of_first(spark, sf_dir).withColumn("score", F.round("score", 6)), 20)


@register("minmax_normalize", f"WITH {COSINE} SELECT id, round({SCALE}, 6) AS norm FROM cs")
def minmax_normalize(spark, sf_dir):
    return r.minmax(cosine_of_first(spark, sf_dir)).select("id", F.round("norm", 6).alias("norm"))


@register("hybrid_topk", CAND + bm25_sql("cand", ASKED) + f""", {COSINE}, l AS (SELECT scores.id, scores.score FROM scores JOIN cs ON cs.id = scores.id), s AS (SELECT cs.id, cs.score FROM cs JOIN scores ON scores.id = cs.id),
l2 AS (SELECT id, {SCALE} AS v FROM l), s2 AS (SELECT id, {SCALE} AS v FROM s), b AS (SELECT l2.id, a.alpha, round(a.alpha * s2.v + (1 - a.alpha) * l2.v, 6) AS score FROM l2 JOIN s2 ON s2.id = l2.id, (VALUES (0.0), (0.3), (0.5), (0.7), (1.0)) a(alpha))
SELECT id, CAST(alpha AS DOUBLE) AS alpha, score FROM (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY score DESC, id) AS rn FROM b) WHERE rn <= 10""")
def hybrid_topk(spark, sf_dir):
    from pyspark.sql import Window

    lexical, semantic = r.bm25(docs(spark, sf_dir), ASKED), cosine_of_first(spark, sf_dir)
    both = lexical.join(semantic.select("id"), "id", "left_semi"), semantic.join(lexical.select("id"), "id", "left_semi")
    blended = r.hybrid(*both, r.ALPHAS).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("alpha").orderBy(F.desc("score"), "id"))
    return blended.withColumn("rn", rank).where("rn <= 10").drop("rn")


@register("content_hash_dedupe", r"""
SELECT 'sha256_' || sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def content_hash_dedupe(spark, sf_dir):
    d = t.load(spark, sf_dir, "documents")
    return d.groupBy(content_key(F.col("text")).alias("content_key")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
