"""Interaction audit of document filters by the multilinear extension of what they remove.

A document fails a set of filters, its mask. For a part of the corpus with n(S) documents of mask S, let x_j be how
far filter j is applied. The documents removed are the polynomial

    r(x) = sum over S of n(S) * (1 - product over j in S of (1 - x_j)) = sum over sets T of c(T) * product over j in T of x_j,
    c(T) = (-1)^(|T| + 1) * (number of documents whose mask holds T), c(empty) = 0.

At the corners, x_j = 1 for the filters applied and else 0, it gives the removed of every prefix of every order. Filter i's
Shapley value is the integral over t from 0 to 1 of the partial derivative of r by x_i at (t, ..., t), taken with exact
rationals; times the number of orders it is what i removes over all of them. Documents are read once and only mask
counts, 32 for each part at most, meet in one task.

Filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * ``[A-Z]`` > 3 * code points; D any of
``#$%&*|``; E the text equals that of a smaller doc_id in the whole table, removed or not.

Defined results: null text is the empty text and equal to it; a null lang is the part of the empty text; a null doc_id
is smaller than none and has no labels, so its row never fails E; rows with one doc_id and text are counted one by one,
and none of them fails E for the other; a document counts as good or toxic if any of its label rows says so, null labels
say nothing; words differ by case; very long texts are measured whole, by one task each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, table, words_of

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
COUNTS = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


class RemovalPolynomial:
    """r(x) of one part, from its documents for each mask (a frozenset of filters)."""

    def __init__(self, counts: dict[frozenset, int]):
        self.documents = sum(counts.values())
        self.terms = {}
        for size in range(1, len(FILTERS) + 1):
            for t in map(frozenset, combinations(FILTERS, size)):
                holding = sum(n for mask, n in counts.items() if t <= mask)
                if holding:
                    self.terms[t] = holding if size % 2 else -holding
        self.corners: dict[frozenset, int] = {}

    def at_corner(self, applied: frozenset) -> int:
        """Documents removed by the filters of ``applied``."""
        if applied not in self.corners:
            self.corners[applied] = sum(c for t, c in self.terms.items() if t <= applied)
        return self.corners[applied]

    def derivative(self, letter: str) -> list[int]:
        """Coefficients, by power of t, of the partial derivative by ``letter`` on the diagonal."""
        powers = [0] * len(FILTERS)
        for t, c in self.terms.items():
            if letter in t:
                powers[len(t) - 1] += c
        return powers

    def shapley(self, letter: str) -> Fraction:
        """The integral of that derivative from 0 to 1."""
        return sum((Fraction(c, power + 1) for power, c in enumerate(self.derivative(letter))), Fraction(0))


def failing(docs: DataFrame) -> DataFrame:
    """key (digest of the text), doc_id, part, mask (letters of A to D that it fails) and the number of such rows, ``n``."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words_of(F.col("text")).alias("words"))
    n_words = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    tests = {
        "A": n_words < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n_words,
        "C": 100 * capitals.cast("bigint") > CAPITAL_PERCENT * F.length("text").cast("bigint"),
        "D": F.col("text").rlike(SIGNS),
    }
    mask = F.concat(*[F.when(test, letter).otherwise("") for letter, test in tests.items()])
    keyed = base.select(F.unhex(F.sha2("text", 256)).alias("key"), "doc_id", "part", mask.alias("mask"))
    return keyed.groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and its documents: ``n``, ``good`` and ``toxic``.

    Copies are found by the least doc_id of each text, which joins on text and doc_id, so that a large group of copies is
    spread out; rows of one doc_id are added up before labels join.
    """
    rows, _ = persisted(failing(docs), "filter-masks")
    least = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    first = F.coalesce("first", F.col("doc_id").isNull())
    masks = rows.join(least, ["key", "doc_id"], "left").select("doc_id", "part", F.concat("mask", F.when(first, "").otherwise("E")).alias("mask"), "n")
    masks = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    flags = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(says("quality"), says("toxic"))
    counted = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return (
        masks.join(flags, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), counted("quality").alias("good"), counted("toxic").alias("toxic"))
    )


def audited(counts: pd.DataFrame) -> Iterator[tuple]:
    """Rows of RESULT for the mask counts of one part: a row for each order of the filters and each step."""
    part, masks = counts["part"].iloc[0], [frozenset(m) for m in counts["mask"]]
    documents, good, toxic = (RemovalPolynomial(dict(zip(masks, map(int, counts[c])))) for c in COUNTS)
    everything = frozenset(FILTERS)
    alone = {f: documents.at_corner(everything) - documents.at_corner(everything - {f}) for f in FILTERS}
    orders = factorial(len(FILTERS))
    share = {f: int(orders * documents.shapley(f)) for f in FILTERS}
    for order in permutations(FILTERS):
        before = frozenset()
        for step, f in enumerate(order, 1):
            after = before | {f}
            removed = documents.at_corner(after) - documents.at_corner(before)
            lost = [p.at_corner(after) - p.at_corner(before) for p in (good, toxic)]
            kept, redundant = documents.documents - documents.at_corner(after), documents.at_corner(frozenset(f)) - removed
            yield part, "".join(order), step, kept, removed, redundant, alone[f], *lost, share[f]
            before = after


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step; see RESULT for its columns."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(counts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(audited(counts), columns=names)

    return mask_counts(docs, labels).groupBy("part").applyInPandas(run, RESULT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)"

ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.doc_id, part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '{SIGNS}') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM {_LETTERS} a, {_LETTERS} b, {_LETTERS} c, {_LETTERS} d, {_LETTERS} e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), x AS (
  SELECT part, filter_order, step, n, good, toxic, contains(mask, f) AS fails, len(translate(mask, earlier, '')) = len(mask) AS present, mask = f AS alone, len(mask) AS failed
  FROM s, m
)
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(coalesce(sum(n) FILTER (present AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (present AND fails), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (NOT present AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (present AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (present AND fails), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // nullif(failed, 0)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""
