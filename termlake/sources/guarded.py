"""Source texts by name, read in ranges: a table of chunks in place of files, and a guard on names.

Every text is cut into chunks of CHUNK characters, stored by the hash of its name. A span reads the chunks it lies in, not
the text. Names are looked up, never opened as paths: one that is absolute, steps upwards or isn't a plain relative path is
outside, whatever files there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

CHUNK, BUCKETS = 4096, 32
MOST_NAMES, MOST_CHUNKS = 100_000, 4000  # broadcast: lengths, and chunks of at most 64 MB


@dataclass
class SourceTexts:
    """``chunks``: name, number, text and bucket; ``lengths``: name and its characters."""

    chunks: DataFrame
    lengths: DataFrame
    buckets: int


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def index_texts(texts: DataFrame, buckets: int = BUCKETS) -> SourceTexts:
    """The chunks of (source_file, text); of a name with several texts the least counts. Null texts are no files."""
    once = texts.where("source_file IS NOT NULL AND text IS NOT NULL").groupBy(F.col("source_file").alias("name")).agg(F.min("text").alias("text"))
    count = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / CHUNK)
    cut = once.select("name", "text", F.explode(F.sequence(F.lit(0), count.cast("int"))).alias("number")).select(
        "name", "number", F.substring(F.col("text"), F.col("number") * CHUNK + 1, F.lit(CHUNK)).alias("text"), bucket_of(F.col("name"), buckets).alias("bucket")
    )
    chunks, _ = stored(cut.hint("rebalance", "bucket").sortWithinPartitions("bucket", "name", "number"), "source-chunks", "bucket")
    lengths, _ = stored(chunks.groupBy("name").agg(F.sum(F.length("text")).alias("n_chars")), "source-lengths")
    return SourceTexts(chunks, lengths, buckets)


def guarded(name: Column) -> Column:
    """``name`` as a plain relative path, empty and ``.`` steps left out; NULL if it is absolute, steps up, or has signs no path has."""
    steps = F.filter(F.split(name, "/"), lambda s: (s != "") & (s != "."))
    outside = name.startswith("/") | F.contains(name, F.lit("\\")) | F.contains(name, F.lit("\0")) | name.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.array_contains(steps, "..") | (F.size(steps) == 0)
    return F.when(name.isNotNull() & ~outside, F.array_join(steps, "/"))


def few(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def read_spans(sources: SourceTexts, asked: DataFrame) -> DataFrame:
    """``asked`` (id, source_file, span_start, span_end) with ``clause_text`` or the reason why there is none.

    Reasons: no_span, outside (the name), no_text (no such source), bad_span.
    """
    start, end = F.col("span_start"), F.col("span_end")
    row = F.monotonically_increasing_id().alias("_row")
    named, _ = stored(asked.select("id", "source_file", "span_start", "span_end", guarded(F.col("source_file")).alias("name"), row), "asked-spans")
    names, _ = stored(sources.lengths.join(few(named.where("name IS NOT NULL").select("name").distinct(), MOST_NAMES), "name", "left_semi"), "asked-names")
    known = named.join(few(names, MOST_NAMES), "name", "left")
    bad = (start < 0) | (end > F.col("n_chars")) | (end <= start)
    reason = F.when(start.isNull() | end.isNull(), "no_span").when(F.col("source_file").isNotNull() & F.col("name").isNull(), "outside").when(F.col("n_chars").isNull(), "no_text").when(bad, "bad_span")
    judged = known.withColumn("reason", reason)
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    bucket = bucket_of(F.col("name"), sources.buckets).alias("bucket")
    wanted = judged.where("reason IS NULL").select("id", "source_file", "span_start", "span_end", "_row", "name", bucket, last.alias("_last"), F.explode(F.sequence(first, last)).alias("number"))
    asked_chunks, _ = stored(wanted.select("bucket", "name", "number").distinct(), "asked-chunks")
    chunks, _ = stored(sources.chunks.join(few(asked_chunks, MOST_NAMES), ["bucket", "name", "number"], "left_semi"), "met-chunks")
    low = F.greatest(start - F.col("number") * CHUNK, F.lit(0))
    piece = F.substring(F.col("text"), (low + 1).cast("int"), (F.least(end - F.col("number") * CHUNK, F.lit(CHUNK)) - low).cast("int"))
    met = wanted.join(few(chunks, MOST_CHUNKS), ["bucket", "name", "number"]).withColumn("piece", piece)  # only the span's part goes on
    whole = [*asked.select("id", "source_file", "span_start", "span_end").columns]
    alone = start.cast("bigint") >= F.col("_last").cast("bigint") * CHUNK
    one = met.where(alone).select(*whole, F.lit(None).cast("string").alias("reason"), F.col("piece").alias("clause_text"))
    pieces = F.array_sort(F.collect_list(F.struct("number", "piece")))["piece"]
    several = met.where(~alone).groupBy("_row", *whole).agg(F.array_join(pieces, "").alias("clause_text")).select(*whole, F.lit(None).cast("string").alias("reason"), "clause_text")
    none = judged.where("reason IS NOT NULL").select(*whole, "reason", F.lit(None).cast("string").alias("clause_text"))
    return none.unionByName(one).unionByName(several)
