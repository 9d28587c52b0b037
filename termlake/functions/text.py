"""Text functions as columns. Python-style white space and digits need ``(?U)`` in Java patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"

# Phrases that bound a number, spellings of legal suffixes, forms of dates, citations and numbers, stop words of attribute names.
BOUND_WORDS = ("greater than", "less than", "more than", "fewer than", "at least", "at most")
SUFFIX_SPELLINGS = {"INCORPORATED": "INC", "CORPORATION": "CORP", "COMPANY": "CO", "LIMITED": "LTD"}
LEGAL_SUFFIXES = ("INCORPORATED", "CORPORATION", "COMPANY", "HOLDINGS", "GROUP", "INC", "CORP", "LLC", "LP", "LTD", "PLC", "NV", "SA", "AB", "CO")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
STATED_DATE = rf"(?iU)\b({MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
PAGE_CITATION = r"(?U)\(Pages?\s*[\d\s,\-–]+\)"
STATED_NUMBER = r"(?U)^(?:within|approximately|about)?\s*(\d+(?:\.\d+)?)\s*(?:%|[a-z])"
NAME_STOP_WORDS = ("answer", "y", "n", "the", "a", "an", "of", "to", "is", "and", "or", "for")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Page citations dropped, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(text, PAGE_CITATION, " "), SPACE, " "))


def content_key(text: Column) -> Column:
    return F.concat(F.lit("sha256_"), F.sha2(strip(F.regexp_replace(text, SPACE, " ")), 256))


def span_id(title: Column, kind: Column, start: Column, end: Column, prefix: str = "cuad_") -> Column:
    key = F.concat_ws("\0", title, kind, start.cast("string"), end.cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 24))


def numeric_from_text(text: Column) -> Column:
    """The number an answer states; a bound ("at least 5 days") or a bare number is none."""
    low = F.lower(strip(text))
    bound = F.lit(False)
    for phrase in BOUND_WORDS:
        bound = bound | low.startswith(phrase)
    number = F.regexp_extract(low, STATED_NUMBER, 1)
    return F.when(~bound & (number != ""), number.try_cast("double"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_name(name: Column) -> Column:
    """Upper case without punctuation, legal suffixes in one spelling."""
    words = F.filter(F.split(F.upper(F.regexp_replace(name, "[^A-Za-z0-9 ]", " ")), " +"), lambda w: w != "")

    def folded(w: Column) -> Column:
        out = w
        for long, short in SUFFIX_SPELLINGS.items():
            out = F.when(w == long, short).otherwise(out)
        return out

    return F.array_join(F.transform(words, folded), " ")


def without_suffix(normalized: Column) -> Column:
    """A normalised name less its last word if that is a legal suffix, else NULL."""
    last = F.substring_index(normalized, " ", -1)
    return F.when(last.isin(*LEGAL_SUFFIXES), F.regexp_replace(normalized, " ?[^ ]+$", ""))


def zero_pad(text: Column, width: int) -> Column:
    """Left-padded with zeros; longer text stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def redact(text: Column) -> Column:
    """Keys, passwords in connection strings (the user stays) and bearer tokens become ``***``."""
    out = F.regexp_replace(text, r"sk-(?:proj-)?[A-Za-z0-9_\-]{16,}", "***")
    out = F.regexp_replace(out, r"(?<=://)([^:/\s]+):([^@/\s]+)(?=@)", "$1:***")
    return F.regexp_replace(out, r"(?i)(bearer\s+)[A-Za-z0-9._\-]{16,}", "$1***")


def truncate(text: Column, limit: int = 200) -> Column:
    more = F.concat(F.left(text, F.lit(limit)), F.lit("…[+"), (F.length(text) - limit).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > limit, more).otherwise(text)


def slice_text(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(text of the span, reason why there is none): exactly one of the two is set."""
    bad = (start < 0) | (end > F.length(text)) | (end <= start)
    reason = (
        F.when(start.isNull() | end.isNull(), "no_span").when(text.isNull(), "no_text").when(bad, "bad_span")
    )
    return F.when(reason.isNull(), F.substring(text, start + 1, end - start)), reason


def header_date(text: Column) -> Column:
    """The first ``Month d, yyyy``, in any case; an impossible day is NULL."""
    found = F.regexp_extract(text, STATED_DATE, 0)  # the text is searched once, what follows reads the few characters found
    stated = F.when(found != "", F.concat_ws(" ", F.initcap(F.regexp_extract(found, STATED_DATE, 1)), F.regexp_extract(found, STATED_DATE, 2), F.regexp_extract(found, STATED_DATE, 3)))
    return F.try_to_date(F.nullif(F.trim(stated), F.lit("")), "MMMM d yyyy")


def keywords(name: Column) -> Column:
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*NAME_STOP_WORDS) & (F.length(w) > 2))


def keyword_hit(words: Column, text: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(text), w))


def keyword_class(words: Column, text: Column, allowed: Column) -> Column:
    """The yes-like answer if a keyword is in the text, else the no-like one; the first answer if there is no such pair."""
    like = lambda word: F.get(F.filter(allowed, lambda p: F.lower(strip(p)) == word), F.lit(0))
    yes, no = like("yes"), like("no")
    pair = yes.isNotNull() & no.isNotNull()
    return F.when(pair, F.when(keyword_hit(words, text), yes).otherwise(no)).otherwise(F.coalesce(F.get(allowed, F.lit(0)), F.lit("")))
