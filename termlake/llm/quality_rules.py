"""Quality rules: a threshold table compiled into one projection, built-in functions only.

Defined results: null text counts as the empty text (no words, no lines); a text without words
fails the base rule; a ratio whose denominator is zero is 0. Repeated rows are judged one by one, and
rows are never compared, so there are no ties; a very long text is measured whole by one task, in n log n
time for its n words; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, table, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was for that with on as are be by it this from at or an "
    "le la les de des du et un une est en que qui dans pour sur par au aux ce avec "
    "der die das und den dem ein eine ist zu von mit auf für im nicht sich auch es "
    "el los las del una por con para se al lo como su no más y o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``low <= value <= high``; ``value`` is SQL over the measured columns."""

    name: str
    value: str
    low: float | None
    high: float | None


def ratio(numerator: str, denominator: str) -> str:
    return f"coalesce({numerator} / nullif({denominator}, 0), 0)"


RULES = (
    Rule("n_words", "n_words", 20, None),
    Rule("mean_word_chars", ratio("word_chars", "n_words"), 2.0, 14.0),
    Rule("symbols_per_word", ratio("n_symbols", "n_words"), None, 0.25),
    Rule("stop_word_share", ratio("n_stop_words", "n_words"), 0.02, None),
    Rule("duplicate_line_share", ratio("n_dup_lines", "n_lines"), None, 0.5),
    Rule("symbol_line_share", ratio("n_bullet_lines", "n_lines"), None, 0.9),
    Rule("repeated_word_share", ratio("n_repeat_words", "n_words"), None, 0.3),
)


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Number of words lying in a ``window``-word window that occurs twice or more.

    ``hashes`` holds one hash per window. The positions of windows with an equal neighbour in hash
    order are sorted again, and each adds the words up to the next such position, ``window`` at most.
    """

    def positions(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.transform(
            F.filter(
                F.arrays_zip(
                    ranked.alias("cur"),
                    F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), ranked).alias("prev"),
                    F.slice(ranked, 2, F.size(h)).alias("next"),
                ),
                lambda z: z["cur"]["h"].isNotNull()
                & ((z["cur"]["h"] == z["prev"]["h"]).eqNullSafe(True) | (z["cur"]["h"] == z["next"]["h"]).eqNullSafe(True)),
            ),
            lambda z: z["cur"]["p"],
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.array_sort(p),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).alias("last")),
            lambda acc, x: F.struct(
                (acc["n"] + F.least(F.lit(window), x - acc["last"])).cast("bigint").alias("n"), x.alias("last")
            ),
            lambda acc: acc["n"],
        )

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
        covered(positions(hashes))
    )


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures that the threshold table reads. Names get ``prefix``.

    The measures come out of a one-element ``inline``: a later filter on them stays above it, where Spark
    would else copy the expressions below every projection and evaluate them many times.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words_name, hashes_name, lines_name = fresh(docs.columns, "_words", "_hashes", "_lines")
    w, h, lines = F.col(words_name), F.col(hashes_name), F.col(lines_name)
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    columns = {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("*", "-", "•"))).cast("bigint"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint"),
        "n_repeat_words": repeated_words(h),
    }
    return (
        docs.withColumns(
            {
                words_name: words_of(F.col(text)),
                lines_name: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
            }
        )
        .withColumn(hashes_name, windows)
        .select(*docs.columns, F.inline(F.array(F.struct(*[v.alias(prefix + k) for k, v in columns.items()]))))
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column for each rule of the threshold table, true where the text passes."""
    out = {}
    for rule in rules:
        value, test = F.expr(rule.value), F.lit(True)
        if rule.low is not None:
            test = test & (value >= rule.low)
        if rule.high is not None:
            test = test & (value <= rule.high)
        out[rule.name] = test
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, ``base_failed``, ``kept`` and the names of the failed rules."""
    tests = compile_rules(rules)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passed = F.lit(True)
    for test in tests.values():
        passed = passed & test
    return measured(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & passed).alias("kept"),
        "n_lines",
        "n_stop_words",
        "n_bullet_lines",
        F.concat_ws(",", *[F.when(~test, F.lit(name)) for name, test in tests.items()]).alias("failed_rules"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), dup AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM dup GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(lines, lambda x: left(ltrim(x, ' '), 1) IN ('*', '-', '•'))) AS BIGINT) AS n_bullet_lines
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         concat_ws(',', {", ".join(
    "CASE WHEN " + " AND ".join(
        [f"({r.value}) >= {r.low}"] * (r.low is not None) + [f"({r.value}) <= {r.high}"] * (r.high is not None)
    ) + f" THEN NULL ELSE '{r.name}' END" for r in RULES)}) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, n_bullet_lines, failed_rules
FROM r
"""
