"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Each text becomes STATISTICS: shares of kinds of characters, lengths of words and lines, and how much of its words,
lines and five-word shingles repeats. Trees of a fixed depth are grown level by level on histograms of logistic
gradients over quantile bins, and flattened into arrays, where node i has children 2 i + 1 and 2 i + 2; scoring goes
down all trees of a block of texts side by side by array lookups.

The model is fitted on a bounded sample: TRAIN_ROWS labelled rows at most, those with the least seeded draws by
doc_id. Scoring reads whole texts, and of each row the text alone.

Defined results: a null text is scored as the empty one; a label whose quality is null, or whose doc_id is null or not
in the table, teaches nothing; any other quality than 1 counts as 0; repeated label rows count each, so contradicting
ones balance; with labels of one kind only, or none, every score is the share of ones, one good and one bad row
added; rows are scored one by one, repeated rows alike, so there are no ties; a very long text is measured whole by
one task in memory of some dozen times its bytes; an empty table gives an empty result; result columns whose names
the table already has get an underscore more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .text_arrays import portions, shingle_hashes, utf8, word_hashes, words

FOLDS, CUT = 5, 0.3
TRAIN_ROWS = 20_000
SEED = 11
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
RIDGE, LEAST_WEIGHT, LEAST_GAIN = 1.0, 2.0, 1e-3
PORTION = 1 << 21  # bytes whose statistics are taken at a time; a longer text is taken alone
SHINGLE = 5

# Kinds of bytes; a byte of no kind below is another ASCII sign. A character beyond ASCII counts by its first byte.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "newline": b"\n", "space": b" \t\x0b\x0c\r",
    "stop": b".,;:", "call": b"!?", "hash": b"#*", "money": b"$%&", "bar": b"|<>", "quote": b"\"'()[]{}", "beyond": bytes(range(0xC0, 0x100)), "inner": bytes(range(0x80, 0xC0)),
}
KIND = np.full(256, len(KINDS), np.uint8)
for _number, _bytes in enumerate(KINDS.values()):
    KIND[list(_bytes)] = _number
SHARES = [*KINDS, "other"]
STATISTICS = [
    "log_chars", "log_words", "log_lines", *[f"share_{k}" for k in SHARES if k != "inner"], "mean_word", "spread_word", "longest_word", "long_words", "capital_words",
    "signed_words", "sign_only_words", "mean_line", "distinct_words", "distinct_lines", "distinct_shingles",
]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``, which may be equal."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of different hashes of each text, 1 where there is none."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    # The text's number stands in the upper bits, so sorting keeps texts apart; 40 bits of hash tell its items apart.
    key = np.sort(owner << np.uint64(40) | hashes >> np.uint64(24))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    found = _sums(new, first)
    return np.where(counts > 0, found / np.maximum(1, counts), 1.0)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text of ``column``."""
    raw, offsets = utf8(column)
    parts = [_statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in portions(offsets, PORTION)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kind = KIND[raw]
    count = {name: _sums(kind == i, offsets) for i, name in enumerate(SHARES)}
    chars = np.diff(offsets) - count["inner"]
    some = np.maximum(1, chars)

    starts, ends, first = words(raw, offsets)
    n_words, length = np.diff(first), ends - starts
    per_word = np.maximum(1, n_words)
    mean = _sums(length, first) / per_word
    spread = np.sqrt(np.maximum(0, _sums(length.astype(np.float64) ** 2, first) / per_word - mean**2))
    longest = np.zeros(len(n_words))
    full = np.flatnonzero(n_words)
    if len(full):
        longest[full] = np.maximum.reduceat(length, first[full])

    def within(names: tuple[str, ...]) -> np.ndarray:
        """Bytes of these kinds in each word."""
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(np.isin(kind, [SHARES.index(n) for n in names]), out=total[1:])
        return total[ends] - total[starts]

    capital, small, signs = within(("upper",)), within(("lower",)), within(("hash", "money", "bar", "call"))
    line_ends = np.flatnonzero(raw == 10)
    line_starts, line_first = _lines(raw, offsets, line_ends)
    line_stops = np.concatenate([line_starts[1:], [len(raw)]]) if len(line_starts) else line_starts
    n_lines = np.diff(line_first)
    line_hashes = word_hashes(raw, line_starts, line_stops)
    shingles, shingle_first = shingle_hashes(raw, offsets, SHINGLE)

    columns = [
        np.log1p(chars), np.log1p(n_words), np.log1p(n_lines), *[count[k] / some for k in SHARES if k != "inner"], mean, spread, np.minimum(longest, 1000),
        _sums(length > 20, first) / per_word, _sums((capital > 1) & (small == 0), first) / per_word, _sums(signs > 0, first) / per_word,
        _sums(signs == length, first) / per_word, chars / np.maximum(1, n_lines), _distinct(word_hashes(raw, starts, ends), first),
        _distinct(line_hashes, line_first), _distinct(shingles, shingle_first),
    ]
    return np.stack(columns, 1)


def _lines(raw: np.ndarray, offsets: np.ndarray, line_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lines of all texts and the number of the first of each (one more at the end); an empty text has none."""
    begins = np.zeros(len(raw) + 1, bool)
    begins[line_ends + 1] = True
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins[: len(raw)])
    return starts, np.searchsorted(starts, offsets)


@dataclass
class Forest:
    """Trees as arrays: column and threshold of each inner node, value of each leaf; ``base`` is added to the values."""

    base: float
    column: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row: all trees are gone down at once, level by level."""
        trees, inner = self.column.shape
        t = np.arange(trees)
        node = np.zeros((len(x), trees), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.column[t, node]] > self.threshold[t, node])
        return 1 / (1 + np.exp(-self.base - self.leaf[t, node - inner].sum(1)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss on histograms of quantile bins; an unsplit node sends all rows left."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves, width = (1 << DEPTH) - 1, 1 << DEPTH, x.shape[1]
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: up to edge b
    place = binned + np.arange(width) * BINS
    margin = np.full(len(y), base)
    columns, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        column, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            here = 1 << depth
            flat = (place + (node * width * BINS)[:, None]).ravel()
            g, h = (np.bincount(flat, np.repeat(v, width), here * width * BINS).reshape(here, width, BINS).cumsum(2) for v in (grad, hess))
            gs, hs = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (gs - g) ** 2 / (hs - h + RIDGE) - gs**2 / (hs + RIDGE)
            gain[(h < LEAST_WEIGHT) | (hs - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(here, -1).argmax(1)
            j, b = best // BINS, best % BINS
            split = gain[np.arange(here), j, b] > LEAST_GAIN
            for k in np.flatnonzero(split):
                column[here - 1 + k], threshold[here - 1 + k] = j[k], edges[j[k]][b[k]]
            right = split[node] & (binned[np.arange(len(y)), j[node]] > b[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        leaf = -RATE * g / (h + RIDGE)
        margin += leaf[node]
        columns.append(column), thresholds.append(threshold), values.append(leaf)
    return Forest(base, np.array(columns), np.array(thresholds), np.array(values))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _measured(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of ``rows`` and ``x``, the statistics of ``text``."""
    at, places = rows.columns.index("text"), [rows.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(at))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(p) for p in places], flat], [*names, "x"])

    return rows.mapInArrow(run, rows.select(*names, F.array(F.lit(0.0)).alias("x")).schema)


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of ``most`` rows at most. Only the sampled doc_ids are broadcast, and only their texts measured."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).cast("double").alias("y"), draw.alias("draw"))
    n = known.count()
    # Twice the rows asked for pass this filter, so that hardly ever too few are left for the exact cut.
    picked = known.where(F.col("draw") < 2.0 * most / max(1, n) * (1 << 40)).orderBy("draw", "doc_id", "y").limit(most).select(F.col("doc_id").alias("id"), "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
    some = _measured(rows, ["doc_id", "y"]).orderBy("doc_id", "y", "x").limit(most).collect()
    return np.array([r["x"] for r in some]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in some])


def quality_model(docs: DataFrame, labels: DataFrame) -> Forest:
    """``labels`` has doc_id and quality; ``docs`` needs doc_id and text of the rows to learn from."""
    return fit(*training_sample(docs, labels))


def scored(docs: DataFrame, model: Forest) -> DataFrame:
    """All columns of ``docs`` with ``_score`` behind them."""
    name = fresh(docs.columns, "_score")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES trees of DEPTH levels: 40 KB
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(statistics(batch.column(at))))], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def op11_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    learn = ~held_out(F.col("doc_id"))
    model = quality_model(docs.where(learn), labels.where(learn))
    rows = scored(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
