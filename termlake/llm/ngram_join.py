"""Near duplicates by MinHash banding, verified on full n-gram sets.

Equal texts form a class first; from then on a class is one row. Bands and rows follow from the target
recall at the threshold. Classes shuffle on band hashes; a bucket whose members equal another bucket's
is dropped. A bucket of one block compares the shingle sets of its texts in one task group. A larger one
is cut into blocks; its texts go once to their block, where each is set against the bucket's least
member, and from then on a text is the shingles it lacks and has besides that member: near copies are a
few numbers. Each pair of blocks is one bounded task group that compares such differences, which give
the full sets' intersection exactly. A pair counts in the first band it shares, so once. Groups return
for each class its number of links and one edge of a spanning forest: rows grow with members, never with
pairs.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than five has one shingle; null counts as the
empty text, and texts without words link only to equal ones; rows equal in text share class and links;
a null doc_id gives way to any other as class id; a very long text is one set, held by the task of its group
(blocks are cut by shingles too); an empty table gives an empty result; other columns are kept or ignored
whatever their names. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, fresh, persisted, release_unused, table
from .components import components
from .text_arrays import mixed, portions, shingle_hashes, utf8

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999
MOST_HASHES, MOST_BANDS = 96, 64  # the number of a band is six bits of its hash
BLOCK_ROWS, BLOCK_SHINGLES = 128, 2_000_000
PORTION = 1 << 18


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach ``recall`` with ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most and bands <= MOST_BANDS:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


BANDS, ROWS = choose_bands()


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key of the text, n (shingles) and the band hashes b0, b1, ...; the number of the band leads a hash."""
    rng = np.random.default_rng(11)
    flips = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = [f"b{i}" for i in range(bands)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            sizes = np.zeros(batch.num_rows, np.int64)
            out = np.zeros((bands, batch.num_rows), np.int64)
            for a, b in portions(offsets, PORTION):
                x, first = shingle_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE)
                sizes[a:b] = np.diff(first)
                some = np.flatnonzero(sizes[a:b])
                if not len(some):
                    continue
                for i in range(bands):
                    band = np.full(len(some), i + 1, np.uint64)
                    for j in range(i * rows, i * rows + rows):
                        band = mixed(band + np.minimum.reduceat((x ^ flips[j]) * factors[j], first[some]))
                    out[i, a + some] = (band >> np.uint64(7) | np.uint64(i << 57)).astype(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(sizes), *map(pa.array, out)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", *names])
        release_unused()

    schema = "doc_id bigint, key string, n bigint, " + ", ".join(f"{c} bigint" for c in names)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").mapInArrow(sketch, schema)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = utf8(texts)
    sets = []
    for a, b in portions(offsets, PORTION):
        x, first = shingle_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE)
        sets += [np.unique(x[first[i] : first[i + 1]]) for i in range(b - a)]
    return sets


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share."""
    m = len(sets)
    common = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    group = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]) - 1
    shared = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    owner, group = owner[shared], np.unique(group[shared], return_inverse=True)[1]
    for c in range(0, int(group.max()) + 1 if len(group) else 0, 4096):
        here = (group >= c) & (group < c + 4096)
        has = np.zeros((m, 4096), np.float32)
        has[owner[here], group[here] - c] = 1
        common += has @ has.T
    return common


def linked(h: int, common: np.ndarray, sizes: np.ndarray, blk: np.ndarray | None, marks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member, and the least member that it reaches by links. ``blk`` keeps to pairs of two blocks."""
    m = len(sizes)
    link = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(link, False)
    if blk is not None:
        link &= blk[:, None] != blk[None, :]
    for k in range(h >> 57):  # counted in an earlier band
        link &= marks[:, k, None] != marks[None, :, k]
    root = np.arange(m)
    while True:
        least = np.where(link, root[None, :], m).min(1)
        step = np.minimum(root, least)
        step = np.minimum(step, step[step])
        if (step == root).all():
            return link.sum(1), root
        root = step


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, of rows that come sorted by ``names``: a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for c in names:
            x = batch.column(batch.schema.get_field_index(c)).to_numpy()
            same &= x == x[-1]
        tail = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        if tail:
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = []
        elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in names):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(tail))
    if held:
        yield pa.Table.from_batches(held)


def groups_of(rows: pa.Table, names: list[str]) -> list[tuple[int, int]]:
    new = np.zeros(max(0, len(rows) - 1), bool)
    for c in names:
        new |= np.diff(rows.column(c).to_numpy()) != 0
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
    return list(zip(cuts, cuts[1:]))


LINKS = "key string, links bigint, root string"


def _links(found: list[tuple[list[str], np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each linked member of the groups ``found``: keys, links and roots."""
    keys, links, roots = [], [], []
    for names, n, root in found:
        some = np.flatnonzero(n)
        keys += [names[i] for i in some]
        links += n[some].tolist()
        roots += [names[root[i]] for i in some]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(links, pa.int64()), pa.array(roots, pa.string())], ["key", "links", "root"])


FIRST = "key string, links bigint, root string, h bigint, blk int, nb int, bands array<bigint>, whole int, lacks binary, has binary"
FIRST_NAMES = [c.split()[0] for c in FIRST.split(", ")]


def compared_texts(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The links of buckets of one block, and the differences of the texts of larger ones.

    ``rows``: h, blk, nb, lead, key, bands, text, sorted by (h, blk) and with the bucket's least member, the ``lead``, in
    front of each block of a larger bucket. Of its members ``whole`` is the number of the lead's shingles, and ``lacks``
    and ``has`` are the hashes that tell the two apart; ``links`` and ``root`` are NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(batches, ["h", "blk"]):
            h, nb, keys = part.column("h").to_numpy(), part.column("nb").to_numpy(), part.column("key").to_pylist()
            texts, bands = part.column("text").combine_chunks(), part.column("bands").combine_chunks()
            linked_groups, apart = [], []
            for a, b in groups_of(part, ["h", "blk"]):
                sets = shingle_sets(texts.slice(a, b - a))
                if nb[a] == 1:
                    sizes = np.array([len(s) for s in sets])
                    marks = np.stack(bands.slice(a, b - a).to_numpy(zero_copy_only=False))
                    linked_groups.append((keys[a:b], *linked(int(h[a]), shared_counts(sets), sizes, None, marks, threshold)))
                else:
                    base = sets[0]
                    apart += [(a + i, len(base), np.setdiff1d(base, x, True).tobytes(), np.setdiff1d(x, base, True).tobytes()) for i, x in enumerate(sets) if i]
            links = _links(linked_groups)
            at = pa.array([x[0] for x in apart], pa.int64())
            n, m = links.num_rows, len(apart)
            columns = [
                pa.concat_arrays([links.column(0), pa.array([keys[x[0]] for x in apart], pa.string())]),
                pa.concat_arrays([links.column(1), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([links.column(2), pa.nulls(m, pa.string())]),
                *[pa.concat_arrays([pa.nulls(n, x.type), x.take(at)]) for x in (part.column(c).combine_chunks() for c in ("h", "blk", "nb", "bands"))],
                *[pa.concat_arrays([pa.nulls(n, t), pa.array([x[i] for x in apart], t)]) for i, t in ((1, pa.int32()), (2, pa.binary()), (3, pa.binary()))],
            ]
            yield pa.RecordBatch.from_arrays(columns, FIRST_NAMES)
        release_unused()

    return rows.mapInArrow(run, FIRST)


def compared_blocks(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links of pairs of blocks. ``pairs``: h, pi, pj, blk, key, bands and the differences, sorted by (h, pi, pj)."""
    group = ["h", "pi", "pj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(batches, group):
            h, pi, pj, blk, whole = (part.column(c).to_numpy() for c in (*group, "blk", "whole"))
            keys, marks = part.column("key").to_pylist(), np.stack(part.column("bands").to_numpy())
            lacks, has = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in ("lacks", "has"))
            found = []
            for a, b in groups_of(part, group):
                less, more = np.array([len(x) for x in lacks[a:b]]), np.array([len(x) for x in has[a:b]])
                common = whole[a] - less[:, None] - less[None, :] + shared_counts(lacks[a:b]) + shared_counts(has[a:b])
                sizes = whole[a] - less + more
                found.append((keys[a:b], *linked(int(h[a]), common, sizes, blk[a:b] if pi[a] != pj[a] else None, marks[a:b], threshold)))
            yield _links(found)

    return pairs.mapInArrow(run, LINKS)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two tables: the rows' doc_id and key; and each key's label (of its group), least doc_id, copies and links."""
    bands, band_rows = choose_bands(threshold)
    sketched, _ = persisted(sketches(docs, bands, band_rows), "sketches")
    names = [f"b{i}" for i in range(bands)]
    classes, classes_path = persisted(
        sketched.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in names]),
        "text-classes",
    )
    members = classes.where("n > 0").select("key", "n", F.explode(F.array(*names)).alias("h"))
    buckets = (
        members.groupBy("h")
        .agg(F.count("*").alias("c"), F.sum("n").alias("words"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
        .where("c > 1")
        .groupBy("c", "x", "y")
        .agg(F.min("h").alias("h"), F.max("words").alias("words"))
        .select("h", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    )
    blk = F.pmod(F.xxhash64("key", F.lit(2)), F.col("nb").cast("bigint")).cast("int")
    rows, rows_path = persisted(members.select("key", "h").join(buckets, "h").withColumn("blk", blk), "bucket-members")
    needed = rows.select("key").distinct().join(classes.select("key", "rep", F.array(*names).alias("bands")), "key")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key(F.col("text")).alias("_key"))
    texts = (
        source.join(needed, (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
        .groupBy("key")
        .agg(F.first("bands").alias("bands"), F.first("text").alias("text"))  # rows with the same doc_id and text
    )
    leads = (  # the least member goes to every block of its bucket
        rows.where("nb > 1").groupBy("h", "nb").agg(F.min("key").alias("key"))
        .select("key", "h", "nb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("blk"), F.lit(True).alias("lead"))
    )
    placed = rows.select("key", "h", "nb", "blk", F.lit(False).alias("lead")).unionByName(leads)
    first, first_path = persisted(
        compared_texts(
            placed.join(texts, "key").select("h", "blk", "nb", "lead", "key", "bands", "text")
            .repartition("h", "blk").sortWithinPartitions("h", "blk", F.desc("lead"), "key"),
            threshold,
        ),
        "bucket-compared",
    )
    apart = first.where("links IS NULL")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    pairs = (
        apart.select("*", other)
        .select("h", F.least("blk", "other").alias("pi"), F.greatest("blk", "other").alias("pj"), "blk", "key", "bands", "whole", "lacks", "has")
        .repartition("h", "pi", "pj")
        .sortWithinPartitions("h", "pi", "pj", "blk", "key")
    )
    links, links_path = persisted(
        first.where("links IS NOT NULL").select("key", "links", "root").unionByName(compared_blocks(pairs, threshold)).groupBy("key", "root").agg(F.sum("links").alias("links")),
        "near-links",
    )
    for path in (rows_path, first_path):
        drop_path(docs.sparkSession, path)
    labels = components(links.where("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    per_key = (
        classes.select("key", "rep", "n_copies")
        .join(links.groupBy("key").agg(F.sum("links").alias("n_links")), "key", "left")
        .join(labels.withColumnRenamed("node", "key"), "key", "left")
        .select("key", F.coalesce("label", "key").alias("label"), "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )
    out = persisted(per_key, "near-classes")[0]
    for path in (classes_path, links_path):
        drop_path(docs.sparkSession, path)
    return sketched.select("doc_id", "key"), out


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the group), n_copies (rows with this text) and n_links (other texts) of each row."""
    rows, per_key = near_classes(docs, threshold)
    ids = per_key.groupBy("label").agg(F.min("rep").alias("class_id"))
    by_key = per_key.join(ids, "label").select("key", "class_id", "n_copies", "n_links")
    return rows.join(by_key, "key").select("doc_id", "class_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each group, that of the least doc_id, with all columns."""
    _, per_key = near_classes(docs, threshold)
    own, key, rep = fresh(docs.columns, "_own", "_key", "_rep")
    first = F.struct(F.col("rep").isNull(), F.col("rep"), F.col("key"))
    kept = per_key.groupBy("label").agg(F.min_by(F.struct("key", "rep"), first).alias("k")).select(F.col("k.key").alias(key), F.col("k.rep").alias(rep))
    chosen = docs.withColumn(own, text_key(F.col("text"))).join(kept, (F.col(own) == F.col(key)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(rep)))
    return chosen.dropDuplicates([key]).select(*docs.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
