"""Text preparation: cleaning, numbers, span ids, redaction, quotes, headers, excerpt spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, keyword_class, keywords, numeric_from_text, redact, span_id
from ..operators.headers import parse_headers
from ..operators.quotes import locate_quotes
from ..operators.spans import locate_spans
from ..sources import tables as t
from ..sources.tables import sql_with

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


@register("clean_text", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text || ' (Pages 12, 14-15)  end', '\(Pages?\s*[\d\s,\-–]+\)', ' ', 'g'), '\s+', ' ', 'g'))) AS clean_md5 FROM documents""")
def clean(spark, sf_dir):
    d = t.load(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(clean_text(F.concat("text", F.lit(" (Pages 12, 14-15)  end")))).alias("clean_md5"))


ANSWERS = ["4 business days", "within 12 months", "50%", "Greater than 5 business days", "5", "about 2.5 years", "", "At least 3 days", "  Approximately 10 % ", "none", "7days", "12. months"]


@register("numeric_from_text", f"""
SELECT position, CASE WHEN position LIKE '% business days' AND position NOT LIKE 'Greater%' THEN CAST(split_part(position, ' ', 1) AS DOUBLE) END AS value, count(*) AS n FROM deal_points GROUP BY 1, 2
UNION ALL SELECT answer, value, 1 FROM (VALUES ('4 business days', 4.0), ('within 12 months', 12.0), ('50%', 50.0), ('Greater than 5 business days', NULL), ('5', NULL),
  ('about 2.5 years', 2.5), ('', NULL), ('At least 3 days', NULL), ('  Approximately 10 % ', 10.0), ('none', NULL), ('7days', 7.0), ('12. months', NULL)) v(answer, value)""", "deal_points")
def numbers(spark, sf_dir):
    read = t.deal_points(spark, sf_dir).groupBy("position").agg(F.count("*").alias("n"))
    said = spark.createDataFrame([(a, 1) for a in ANSWERS], "position string, n bigint")
    return read.unionByName(said).select("position", numeric_from_text(F.col("position")).alias("value"), "n")


@register("span_id", """
SELECT matter_id, deal_point_name, 'cuad_' || left(sha256(CAST(matter_id AS STRING) || chr(0) || deal_point_name || chr(0) || span_start || chr(0) || span_end), 24) AS id
FROM deal_points WHERE span_start IS NOT NULL""", "deal_points")
def span_ids(spark, sf_dir):
    d = t.deal_points(spark, sf_dir).where("span_start IS NOT NULL")
    return d.select("matter_id", "deal_point_name", span_id(F.col("matter_id").cast("string"), F.col("deal_point_name"), F.col("span_start"), F.col("span_end")).alias("id"))


LINES = ["key sk-proj-abcdefghijklmnop1234 end", "postgres://user:secret@host/db", "Authorization: Bearer abcdefghijklmnop.1234", "nothing here", "sk-short"]
REDACT_SQL = """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' ' || suffix, 'sk-(?:proj-)?[A-Za-z0-9_\\-]{16,}', '***', 'g'),
  '(://[^:/\\s]+):[^@/\\s]+@', '\\1:***@', 'g'), '([Bb][Ee][Aa][Rr][Ee][Rr]\\s+)[A-Za-z0-9._\\-]{16,}', '\\1***', 'g') AS line
FROM documents, (VALUES """


@register("redact", REDACT_SQL + ", ".join(f"('{x}')" for x in LINES) + ") v(suffix)")
def redacted(spark, sf_dir):
    whole = t.load(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" ")).alias("text"))
    lines = whole.select("doc_id", "text", F.explode(F.array(*map(F.lit, LINES))).alias("suffix"))
    return lines.select("doc_id", redact(F.concat("text", "suffix")).alias("line"))


@register("locate_quote", """
SELECT d.doc_id, b.item_id, CAST(strpos(d.text, b.text) - 1 AS INT) AS span_start, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS INT) AS span_end
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def locate_quote(spark, sf_dir):
    """Items quoted in documents, wherever and however often."""
    d, b = t.load(spark, sf_dir, "documents").select("doc_id", "text"), t.load(spark, sf_dir, "benchmark")
    return locate_quotes(d, b.select("item_id", F.col("text").alias("quote")))


POINT = "Hentat or onhe answer"


@register("keyword_classifier", """
SELECT doc_id, CASE WHEN contains(lower(text), 'hentat') OR contains(lower(text), 'onhe') THEN 'Yes' ELSE 'No' END AS predicted FROM documents""")
def keyword_classifier(spark, sf_dir):
    allowed = F.array(F.lit("No"), F.lit("Yes"))
    return t.load(spark, sf_dir, "documents").select("doc_id", keyword_class(keywords(F.lit(POINT)), F.col("text"), allowed).alias("predicted"))


LONGEST = 500
SIZES = (500, 280, 150, 80, 500, 280, 150, 80)  # of the parts of the eighths: each anchor but the least is the longest of some


@register("span_locate", None)
def span_locate(spark, sf_dir):
    """Excerpts cut from the documents, with citations and collapsed space, located again.

    Of each text of 2 * LONGEST characters or more there is one for each eighth, its parts from the eighth's place
    and from the text's end, long enough for every anchor; a shorter text is one part, whole.
    """
    d = t.load(spark, sf_dir, "documents").select("doc_id", "text")
    eighths = F.when(F.length("text") < 2 * LONGEST, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(8))))
    placed = d.select("doc_id", "text", F.length("text").alias("n"), F.explode(eighths).alias("k"))
    at = F.floor((F.col("n") - 2 * LONGEST) * F.col("k") / 7).cast("int") + 1
    size = F.get(F.array(*map(F.lit, SIZES)), F.col("k"))
    parts = F.concat(F.substring("text", at, size), F.lit(" (Page 3)"), F.lit("<omitted>"), F.substring("text", F.col("n") - size + 1, size))
    cut = F.when(F.col("n") < 2 * LONGEST, F.concat("text", F.lit(" (Page 3)"))).otherwise(parts)
    excerpts = placed.select((F.col("doc_id") * 10 + F.col("k")).alias("id"), "doc_id", F.regexp_replace(cut, r"\s+", " ").alias("excerpt"))
    return locate_spans(excerpts, d)


# Agreements between the parties of a matter; every third one is made through a company formed for it.
HEADER = """concat('AGREEMENT ', CASE WHEN id % 3 = 0 AND buyer <> '' THEN concat('by and among ', buyer, ' HOLDINGS, INC., ', buyer, ' MERGER SUB, INC. and ', seller, ' SYSTEMS GROUP, INC.')
  WHEN buyer <> '' THEN concat('AND PLAN OF MERGER between ', buyer, ' CORPORATION and ', seller, ' COMPANY') ELSE concat('by and between ', seller, ' COMPANY') END,
  ' Dated as of ', signed, CASE WHEN id % 2 = 0 THEN ' TABLE OF CONTENTS ' ELSE ' ARTICLE IV ' END, 'OTHER NAMES INC. and June 5, 2031')"""
SIDES = "SELECT id, coalesce(acquirer_name, '') AS buyer, upper(replace(target_name, '#', ' ')) AS seller, signing_date, {signed} AS signed FROM {matters} WHERE signing_date IS NOT NULL"


@register("parse_header", f""", s AS ({SIDES.format(signed="upper(strftime(signing_date, '%B')) || ' ' || day(signing_date) || ', ' || year(signing_date)", matters="matters")})
SELECT id, CASE WHEN buyer = '' THEN NULL WHEN id % 3 = 0 THEN buyer || ' HOLDINGS, INC.' ELSE buyer || ' CORPORATION' END AS acquirer_name,
       CASE WHEN id % 3 = 0 AND buyer <> '' THEN seller || ' SYSTEMS GROUP, INC.' ELSE seller || ' COMPANY' END AS target_name, signing_date,
       CAST(CASE WHEN buyer = '' THEN 1 WHEN id % 3 = 0 THEN 3 ELSE 2 END AS INT) AS n_parties FROM s""", "matters")
def headers(spark, sf_dir):
    """Headers written for all dated matters and read again."""
    sides = spark.sql(SIDES.format(signed="upper(date_format(signing_date, 'MMMM d, yyyy'))", matters="{m}"), m=t.matters(spark, sf_dir))
    spread = sides.repartition(4 * spark.sparkContext.defaultParallelism, "id")  # a file of small rows is much work
    parsed = parse_headers(spread.select("id", F.expr(HEADER).alias("text")))
    return parsed.select("id", "acquirer_name", "target_name", "signing_date", F.size("parties").alias("n_parties"))


ANCHORED = "CASE WHEN n >= 400 THEN 400 WHEN n >= 200 THEN 200 WHEN n >= 100 THEN 100 WHEN n >= 50 THEN 50 WHEN n >= 30 THEN 30 ELSE 20 END"


@register("span_located", rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
e AS (SELECT *, CASE WHEN length(text) < 900 THEN text ELSE trim(substring(text, CAST(length(text) * 3 // 10 AS INT) + 1, 260)) END AS excerpt FROM d),
k AS (SELECT doc_id, text, excerpt, {ANCHORED.replace("n >=", "length(excerpt) >=")} AS k FROM e), p AS (SELECT *, strpos(text, left(excerpt, k)) AS begin FROM k)
SELECT doc_id AS id, doc_id, CAST(CASE WHEN length(excerpt) >= 20 THEN begin - 1 ELSE -1 END AS INT) AS span_start,
       CAST(CASE WHEN length(excerpt) >= 20 THEN begin - 2 + strpos(substring(text, begin), right(excerpt, k)) + k ELSE -1 END AS INT) AS span_end FROM p""")
def span_located(spark, sf_dir):
    """An excerpt of every document with single spaces, found where its head and then its tail stand first; -1 if it is too short for an anchor."""
    d = t.load(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    piece = F.trim(F.substring(F.col("text"), F.floor(F.length("text") * 3 / 10).cast("int") + 1, F.lit(260)))
    excerpts = d.select(F.col("doc_id").alias("id"), "doc_id", F.when(F.length("text") < 900, F.col("text")).otherwise(piece).alias("excerpt"))
    place = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
    return locate_spans(excerpts, d).select("id", "doc_id", place("span_start"), place("span_end"))
