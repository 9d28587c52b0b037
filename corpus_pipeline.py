"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined results: a null or letterless text has no language and goes; a null doc_id is an id like others, a null source
a source of its own, a null lang no label; rows equal in text are one document, the one with the least doc_id, and a
null doc_id gives way to any other; of rows equal in doc_id and text one stays; a table without labels has no language
for any text and keeps nothing; an empty benchmark takes nothing away; an empty table gives an empty index; very long
texts go through whole; further columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm.common import drop_path, intermediates, persisted, table
from termlake.llm.decontaminate import decontaminated
from termlake.llm.language_crf import UND, language_model, predicted
from termlake.llm.mixing import repeated
from termlake.llm.ngram_join import one_of_each
from termlake.llm.token_files import token_index

LEAST_SCORE = 0.4  # a text whose language has a smaller share of its words is rejected


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or without a language that leads clearly, go."""
    labelled = predicted(docs, language_model(docs))
    lang, score = labelled.columns[-2:]
    return labelled.where((F.col(lang) != UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal and near-equal texts, the one with the least doc_id."""
    return one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources repeats them."""
    return repeated(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows; returns their index: doc_id, start, n_tokens, ids_crc32. ``files_of`` names their folder."""
    return token_index(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# Language models, MinHash and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way goes when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with intermediates(spark):
            out = stage(spark, docs, sf_dir)
            docs, path = persisted(out, f"pipeline-{name}", kept=True)
        if before:
            drop_path(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_path(spark, before)  # the index is read from the token files
    return out
