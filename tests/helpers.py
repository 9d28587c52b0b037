"""Small document tables for tests: nulls, empty texts, repeated rows, further columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """``rows``: (doc_id, text)."""
    return spark.createDataFrame([(i, text, "en", "src0", len(text or "")) for i, text in rows], SCHEMA)


def saved(spark, df, path, name="documents"):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
