"""The pipeline on tables that lack what they should have."""

import pytest

import corpus_pipeline

from .helpers import SF, docs, saved


def frames(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def test_empty_table_and_table_without_labels(spark, tmp_path):
    whole, bench = frames(spark)
    saved(spark, bench, tmp_path, "benchmark")
    for table in (whole.where("false"), whole.limit(20).withColumn("lang", whole["lang"].substr(1, 0)).where("false"), docs(spark, [(1, "some words", None, "a"), (2, None, None, None)]).select(*whole.columns)):
        assert corpus_pipeline.run(spark, saved(spark, table, tmp_path)).count() == 0


@pytest.mark.parametrize("with_benchmark", [True, False])
def test_null_rows_ties_and_repeated_rows(spark, tmp_path, with_benchmark):
    whole, bench = frames(spark)
    text = {r.doc_id: r.text for r in whole.where("lang = 'en' AND n_chars > 300").orderBy("doc_id").limit(3).collect()}
    first = min(text)
    own = text[first] + " and a few words more so that this text is one of its own for once with nothing like it anywhere in here"
    edge = [(900_001, None, "en", "src0"), (900_002, "", None, None), (900_003, " \t12 34\n", "en", None), (900_004, text[first], "en", "src0"), (first, text[first], "en", "src0"), (None, text[first], None, None), (None, own[::-1].replace(" ", " e "), "en", None)]
    table = whole.withColumn("extra", whole["doc_id"] * 2).withColumn("_key", whole["source"])
    more = docs(spark, edge).select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", "doc_id AS extra", "source AS _key")
    sf = saved(spark, table.unionByName(more), tmp_path)
    saved(spark, bench if with_benchmark else bench.where("false"), tmp_path, "benchmark")
    found = [r.doc_id for r in corpus_pipeline.run(spark, sf).collect()]
    assert not {900_001, 900_002, 900_003, 900_004} & set(found) and len(found) > 100
    kept = docs_after(spark, sf)
    assert kept.count(first) <= 1


def docs_after(spark, sf):
    """Ids after the first two stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
    return [r.doc_id for r in docs.select("doc_id").collect()]
