"""Agreement headers: signing date natively; party names and roles in an Arrow function, as they walk the text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, header_date

# Endings of party names, words before them, and marks of companies formed for a merger.
ENDINGS = r"INCORPORATED|CORPORATION|COMPANY|HOLDINGS|GROUP|INC|CORP|LLC|L\.L\.C\.|LP|L\.P\.|LTD|PLC|N\.V\.|S\.A\.|AB|CO"
FURTHER = r"INCORPORATED|CORPORATION|COMPANY|INC|CORP|LLC|L\.L\.C\.|LP|L\.P\.|LTD|PLC|N\.V\.|S\.A\."
LEADS = r"BY AND AMONG|AND AMONG|AMONG|BETWEEN|AND|BY|THE"
VEHICLES = r"MERGER SUB|MERGERSUB|ACQUISITION|BIDCO|MERGER CORP|SUB,|MERGER PARENT|HOLDCO"

# Where a header ends, what a signing date looks like, what stands before and behind the parties.
HEAD_CHARS = 1500
HEADER_END = r"(?iU)TABLE OF CONTENTS|ARTICLE\s+(?:[IVX]+|\d+)\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SIGNED = rf"(?iU)\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b"
BEFORE_PARTIES = r"(?iU)^.*?\b(?:by and among|by and between|among|between)\b[:\s]*"
BEHIND_PARTIES = r"(?iU)\b(?:Dated as of|dated)\b.*"

PARTY = re.compile(rf"[A-Z][A-Za-z0-9&'’./\-\s]{{2,70}}?,?\s+(?:{ENDINGS})\.?(?![A-Za-z])(?:,?\s+(?:{FURTHER})\.?(?![A-Za-z]))*")
LEAD = re.compile(rf"(?:(?:{LEADS}) [\s,:]*)+", re.I)


def party_names(block: str) -> list[str]:
    """Distinct names that end in a legal suffix, in order, without the words that lead up to them."""
    found = (LEAD.sub("", m[0].strip(" ,:\n"), count=1) if LEAD.match(m[0].strip(" ,:\n")) else m[0].strip(" ,:\n") for m in PARTY.finditer(block))
    return list(dict.fromkeys(name for name in found if len(name) >= 4))


def roles(parties: list[str]) -> tuple[str | None, str | None]:
    """(acquirer, target): a single shared first word marks the buyers; else vehicles aside, the first buys the last."""
    stems = [(re.sub(r"[^A-Z0-9 ]", "", p.upper()).split() or [""])[0] for p in parties]
    shared = {s for s in stems if s and stems.count(s) > 1}
    if len(shared) == 1:
        buyers = [p for p, s in zip(parties, stems) if s in shared]
        rest = [p for p, s in zip(parties, stems) if s not in shared]
        if len(rest) == 1:
            return buyers[0], rest[0]
    real = [p for p in parties if not re.search(VEHICLES, p.upper())]
    if not real:
        return None, None
    return (real[0], real[-1]) if len(real) > 1 else (None, real[0])


SIDES = T.StructType(
    [T.StructField("acquirer_name", T.StringType()), T.StructField("target_name", T.StringType()), T.StructField("parties", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(SIDES)
def parse_parties(blocks: pd.Series) -> pd.DataFrame:
    found = [party_names(b or "") for b in blocks]
    sides = [roles(p) for p in found]
    return pd.DataFrame({"acquirer_name": [a for a, _ in sides], "target_name": [t for _, t in sides], "parties": found})


def header_of(text: Column) -> Column:
    """The cleaned first HEAD_CHARS characters up to the table of contents or the first article."""
    head = F.regexp_replace(clean_text(F.left(text, F.lit(HEAD_CHARS))), "^﻿+", "")
    return F.element_at(F.split(head, HEADER_END, 2), 1)


def parse_headers(texts: DataFrame, key: str = "id") -> DataFrame:
    """key, acquirer_name, target_name, signing_date and parties of each text."""
    head = F.col("_head")
    block = F.regexp_replace(F.element_at(F.split(F.regexp_replace(head, BEFORE_PARTIES, ""), SIGNED, 2), 1), BEHIND_PARTIES, "")
    parsed = texts.select(key, header_of(F.col("text")).alias("_head")).select(key, header_date(head).alias("signing_date"), parse_parties(block).alias("p"))
    return parsed.select(key, "p.acquirer_name", "p.target_name", "signing_date", "p.parties")
