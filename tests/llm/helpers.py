"""Small tables for the operators: nulls, empty and long texts, ties, repeated rows, clashing names."""

import os

DATA = os.environ.get("TERMLAKE_TESTDATA", "/root/testdata")
SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, size long, shard int"


def docs(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, lang, source); further columns clash with those of results."""
    full = [(*r, *("en", "src0")[len(r) - 2 :])[:4] for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, True, 9, 3) for r in full], SCHEMA)


def saved(spark, df, path, name="documents"):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
