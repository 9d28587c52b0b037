"""Readers of the source formats: text folders, annotated CSV, nested JSON, ontology XML, name indexes, logs, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, normalize_name, span_id, zero_pad

ONTOLOGY_SCHEMA = """
`_rdf:about` string, `rdfs:label` string, `skos:definition` string, `skos:altLabel` array<string>,
`rdfs:subClassOf` array<struct<`_rdf:resource`: string>>
"""


NESTED_SCHEMA = """
data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<id: string, answers: array<struct<text: string, answer_start: bigint>>>>>>>>
"""


def text_folder(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """One row per file (``source_file``, ``text``), ordered by the number that ends the name; the order takes a second pass over the files."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))
    if not ordered:
        return files
    number = F.expr("try_cast(regexp_extract(source_file, '([0-9]+)[^0-9]*$', 1) AS int)")
    return files.orderBy(number.asc_nulls_last(), "source_file")


def annotated_csv(spark: SparkSession, path: str, keep: str = "main", drop_titles: tuple[str, ...] = ()) -> DataFrame:
    """Annotation rows of all CSV files below ``path``; quoted fields may span lines and be of any length."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    return rows.where((F.col("data_type") == keep) & ~F.col("contract_name").isin(*drop_titles))


def vocabulary_of(rows: DataFrame, column: str = "question") -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def nested_qa(spark: SparkSession, path: str) -> DataFrame:
    """Answered spans of a nested question-answer file; an unanswered category yields no row."""
    data = spark.read.schema(NESTED_SCHEMA).json(path, multiLine=True).select(F.explode("data").alias("d"))
    spans = (
        data.select("d.title", F.explode("d.paragraphs").alias("p"))
        .select("title", "p.context", F.explode("p.qas").alias("q"))
        .select("title", "context", "q.id", F.explode("q.answers").alias("a"))
    )
    start = F.col("a.answer_start").cast("int")
    end = start + F.length("a.text")
    kind = F.substring_index("id", "__", -1)
    return spans.select(
        span_id(F.col("title"), kind, start, end).alias("id"), "title", kind.alias("clause_type"), F.col("a.text").alias("text"),
        start.alias("char_start"), end.alias("char_end"),
    )


def ontology_classes(spark: SparkSession, path: str) -> DataFrame:
    """Labelled classes: code, label, definition, sorted parent codes and distinct aliases other than the label."""
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(ONTOLOGY_SCHEMA).load(path)
    code = lambda uri: F.substring_index(uri, "/", -1)
    label = F.col("rdfs:label")
    return rows.where(F.col("`_rdf:about`").isNotNull() & label.isNotNull()).select(
        code(F.col("`_rdf:about`")).alias("code"),
        label.alias("label"),
        F.col("skos:definition").alias("definition"),
        F.array_sort(F.array_compact(F.transform(F.coalesce("rdfs:subClassOf", F.array()), lambda x: code(x["_rdf:resource"])))).alias("parents"),
        F.array_distinct(
            F.filter(F.transform(F.coalesce("skos:altLabel", F.array()), lambda x: F.trim(x)), lambda x: (x != "") & (x != label))
        ).alias("aliases"),
    )


def name_index(spark: SparkSession, path: str) -> DataFrame:
    """``NAME:ID:`` lines to (name, cik): the first line of a normalised name wins."""
    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\u0001", quote="", schema="line string")
    at = F.monotonically_increasing_id()  # file order within one file
    parts = lines.withColumn("at", at).select("at", F.substring_index("line", ":", 1).alias("raw"), F.regexp_replace("line", "^[^:]*:", "").alias("rest"))
    keyed = parts.select("at", "raw", F.regexp_replace("rest", r"^[: \n]+|[: \n]+$", "").alias("cik")).where("raw <> '' AND cik <> ''")
    return keyed.select("at", normalize_name(F.col("raw")).alias("name"), zero_pad(F.col("cik"), 10).alias("cik")).groupBy("name").agg(F.min_by("cik", "at").alias("cik"))


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """A commented CSV; every column stays text, so leading zeros survive."""
    rows = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    return rows.select(*[F.trim(c).alias(c) for c in rows.columns])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.json(path, mode="DROPMALFORMED")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def titles(texts: DataFrame) -> DataFrame:
    """``texts`` with a title: its first 600 characters cleaned, without a byte order mark, 200 at most."""
    head = F.regexp_replace(clean_text(F.left("text", F.lit(600))), "^﻿+", "")
    return texts.withColumn("title", F.coalesce(F.nullif(F.trim(F.left(head, F.lit(200))), F.lit("")), F.lit("untitled")))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (file, then row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
