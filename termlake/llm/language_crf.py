"""Language identification by a linear-chain conditional random field over the words of a text.

Features of a word: its character n-grams (1 to 4 bytes, lower case), its affixes (first and last three
bytes, told apart from inner n-grams) and the word itself as a lexicon entry; all hashed into one weight
table. Transitions between labels are learned. Training texts carry one label each, so training sequences
string together spans of differently labelled texts: that is where the transitions come from. Words
are labelled by forward-backward; a text's language is the one with the largest expected share of its
words, and the score is that share.

The model is fitted on a bounded sample: TRAIN_TEXTS labelled texts of each language (MOST_TEXTS in all),
distinct ones with the least seeded draws, of each at most TRAIN_WORDS words from a seeded place; so copies of
one text count once. Languages are the MOST_LANGUAGES labels with the most rows, of equally frequent ones the first by
code point; rarer labels teach nothing. The weight table has SLOTS rows, fewer with so many languages that it would
pass MOST_WEIGHTS (64 MB); the moves between languages take 8 MB at most. Prediction reads whole texts; chains that run
side by side are fewer bytes with more languages.

Words of a chain are those with an ASCII letter, an apostrophe or a character beyond ASCII.

Defined results: null text, or one without a letter, is ``und`` with score 0; so is every text if no row
can be learned from; rows are predicted one by one, repeated rows alike; a null lang is no label; of languages
with equal shares the first by code point wins; a very long text is one chain, worked on by one task in
memory of some dozen bytes a word and language; an empty table gives an empty result; result columns whose
names the table already has get an underscore more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, release_unused, table, words_of
from .text_arrays import mixed, portions, utf8, words

FOLDS = 5
TRAIN_TEXTS, TRAIN_WORDS = 400, 150
MOST_TEXTS = 8000  # training texts of all languages together
SLOTS, MOST_WEIGHTS = 1 << 17, 1 << 24
MOST_LANGUAGES = 1000
SEQUENCE, EPOCHS, BATCH, RATE = 48, 4, 64, 0.15
SEED = 3
PORTION = 1 << 19  # bytes whose features are held at a time
CHAIN_BYTES = 1 << 24  # bytes times languages of whole texts whose chains run side by side; a longer text runs alone
UND = "und"

# Bytes of words: ASCII letters and the apostrophe, and all bytes of characters beyond ASCII.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[39, *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    moves: np.ndarray  # languages x languages, log scale


def slots_for(languages: int) -> int:
    """Rows of the weight table: a power of two, so that the table stays within MOST_WEIGHTS."""
    return min(SLOTS, 1 << (MOST_WEIGHTS // max(1, languages)).bit_length() - 1)


def features(raw: np.ndarray, offsets: np.ndarray, n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, word of each slot, number of the first word of each text) for words with a letter."""
    starts, ends, first = words(raw, offsets)
    n_words = len(starts)
    if not n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    low = LOWER[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    low = np.where(after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97), raw + 32, low)  # capitals of Latin-1
    owner = np.repeat(np.arange(n_words), ends - starts)
    at = np.flatnonzero(_inside(len(raw), starts, ends))
    ok = IS_LETTER[raw[at]]
    at, owner = at[ok], owner[ok]
    x = low[at].astype(np.uint64) + np.uint64(1)
    n = len(x)
    slots, of = [], []
    gram = np.zeros(n, np.uint64)
    for k in range(4):
        m = n - k
        if m <= 0:
            break
        gram = gram[:m] * np.uint64(257) + x[k:]
        same = owner[:m] == owner[k:]
        slots.append(mixed(gram[same] + np.uint64(k << 40)) % np.uint64(n_slots))
        of.append(owner[:m][same])
        if k == 2:  # affixes
            begins = same & np.concatenate([[True], owner[1:m] != owner[: m - 1]])
            stops = same & np.concatenate([owner[k:][:-1] != owner[k + 1 :], [True]])
            for tag, where in ((9, begins), (10, stops)):
                slots.append(mixed(gram[where] + np.uint64(tag << 40)) % np.uint64(n_slots))
                of.append(owner[:m][where])
    if n:
        total = np.zeros(n_words, np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = np.arange(n) - np.repeat(edge, np.diff([*edge, n]))
        np.add.at(total, owner[edge], np.add.reduceat(mixed(x + (rank.astype(np.uint64) << np.uint64(9))), edge))
        have = owner[edge]
        slots.append(mixed(total[have] + np.uint64(11 << 40)) % np.uint64(n_slots))
        of.append(have)
    return np.concatenate(slots).astype(np.int64) if slots else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64), first


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    return np.cumsum(step[:-1]).astype(bool)


def emissions(weights: np.ndarray, slots: np.ndarray, of: np.ndarray, n_words: int) -> np.ndarray:
    """Scores of each word for each language, scaled by its number of features."""
    out = np.stack([np.bincount(of, weights[slots, k], n_words) for k in range(weights.shape[1])], 1)
    return out / np.sqrt(np.maximum(1, np.bincount(of, minlength=n_words)))[:, None]


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label chances of every word, texts side by side, and the expected moves between labels. Overwrites ``scores``.

    ``first`` has each text's first word. Texts are ordered by length, so that each step is one array operation.
    """
    counts, k = np.diff(first), scores.shape[1]
    local = scores
    local -= local.max(1, keepdims=True)
    np.exp(local, out=local)
    step = np.exp(moves - moves.max()).astype(local.dtype)
    order = np.argsort(-counts, kind="stable")
    starts, lengths = first[:-1][order], counts[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts longer than t
    alpha = np.empty_like(local)
    a = None
    for t in range(longest):
        rows = starts[: active[t]] + t
        a = local[rows] if t == 0 else (a[: active[t]] @ step) * local[rows]
        a /= a.sum(1, keepdims=True)
        alpha[rows] = a
    expected = np.zeros((k, k))
    b = np.ones((0, k), local.dtype)
    for t in range(longest - 2, -1, -1):  # alpha becomes the chances; a last word's are alpha itself
        n = active[t + 1]
        if len(b) < n:
            b = np.concatenate([b, np.ones((n - len(b), k), local.dtype)])
        rows = starts[:n] + t
        onward, here = local[rows + 1] * b, alpha[rows]
        b = onward @ step.T
        both = here * b
        norm = both.sum(1, keepdims=True)
        expected += (here.T @ (onward / norm)) * step
        alpha[rows] = both / norm
        b /= b.sum(1, keepdims=True)
    return alpha, expected


def fit(texts: list[tuple[str, str]], seed: int = SEED) -> Model | None:
    """Conditional likelihood by minibatch steps with per-weight rates, on strings of spans from ``texts``."""
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    code = {lang: i for i, lang in enumerate(languages)}
    k, n_slots = len(languages), slots_for(len(languages))
    raw, offsets = utf8(pa.array([t for t, _ in texts], pa.string()))
    slots, of, first = features(raw, offsets, n_slots)
    order = np.argsort(of, kind="stable")
    slots, of = slots[order], of[order]
    bounds = np.searchsorted(of, np.arange(first[-1] + 1))
    label = np.array([code[lang] for _, lang in texts])
    by_label = [np.flatnonzero((label == i) & (np.diff(first) > 0)) for i in range(k)]
    by_label = [x for x in by_label if len(x)]
    if not by_label:
        return None
    weights, moves = np.zeros((n_slots, k)), np.zeros((k, k))
    seen_w, seen_m = np.full((n_slots, k), 1e-6), np.full((k, k), 1e-6)
    sequences = max(BATCH, int(first[-1]) // SEQUENCE)
    for _ in range(EPOCHS * sequences // BATCH):
        picked, truth = [], []
        for _ in range(BATCH):
            got = 0
            while got < SEQUENCE:  # spans of whole-text runs, each from a text of a random language
                pool = by_label[rng.integers(len(by_label))]
                d = pool[rng.integers(len(pool))]
                size = int(first[d + 1] - first[d])
                take = min(size, SEQUENCE - got, int(rng.integers(4, SEQUENCE + 1)))
                at = int(first[d]) + int(rng.integers(size - take + 1))
                picked.append(np.arange(at, at + take))
                truth.append(np.full(take, label[d]))
                got += take
        word, y = np.concatenate(picked), np.concatenate(truth)
        lengths = bounds[word + 1] - bounds[word]
        flat = np.repeat(bounds[word] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        s, o = slots[flat], np.repeat(np.arange(len(word)), lengths)
        scores = emissions(weights, s, o, len(word))
        chances, expected = forward_backward(scores, np.arange(0, len(word) + 1, SEQUENCE), moves)
        error = -chances
        error[np.arange(len(word)), y] += 1
        error /= np.sqrt(np.maximum(1, lengths))[:, None]
        unique, inverse = np.unique(s, return_inverse=True)
        grad = np.stack([np.bincount(inverse, error[o, i], len(unique)) for i in range(k)], 1) / BATCH - 1e-4 * weights[unique]
        seen_w[unique] += grad**2
        weights[unique] += RATE * grad / np.sqrt(seen_w[unique])
        inner = np.flatnonzero(np.arange(len(word)) % SEQUENCE)
        counted = np.zeros((k, k))
        np.add.at(counted, (y[inner - 1], y[inner]), 1)
        grad = (counted - expected) / BATCH - 1e-3 * moves
        seen_m += grad**2
        moves += RATE * grad / np.sqrt(seen_m)
    return Model(languages, weights.astype(np.float32), moves)


def label_words(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Label chances of the words of a column of texts, and each text's first word; words without a letter add nothing."""
    raw, offsets = utf8(column)
    parts, firsts, done = [], [np.zeros(1, np.int64)], 0
    for a, b in portions(offsets, PORTION):
        slots, of, first = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], len(model.weights))
        has = np.unique(of)  # only words with a letter stay in the chain
        place = np.searchsorted(has, of)
        parts.append(emissions(model.weights, slots, place, len(has)).astype(np.float32))
        firsts.append(np.searchsorted(has, first[1:]) + done)
        done += len(has)
    first = np.concatenate(firsts)
    scores = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)), np.float32)
    return forward_backward(scores, first, model.moves)[0], first


def training_sample(docs: DataFrame, seed: int = SEED) -> list[tuple[str, str]]:
    """Pairs (span of words, lang): of each language the distinct texts with the least draws, TRAIN_TEXTS or an even part of MOST_TEXTS."""
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40))
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", draw.alias("draw"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("draw").alias("texts"))
    top = counts.orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES).select("lang", "texts").collect()
    per_language = max(1, min(TRAIN_TEXTS, MOST_TEXTS // max(1, len(top))))
    # Twice the texts asked for pass this filter, so that hardly ever too few are left; equal texts pass together.
    limits = docs.sparkSession.createDataFrame([(r["lang"], 2.0 * per_language / r["texts"] * (1 << 40)) for r in top], "lang string, limit double")
    w = words_of(F.col("text"))
    place = F.floor(F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(1 << 40)) / (1 << 40) * (F.greatest(F.size(w) - TRAIN_WORDS, F.lit(0)) + 1))
    rows = (
        labelled.join(F.broadcast(limits), "lang")  # MOST_LANGUAGES rows at most
        .where("draw < limit")
        .groupBy("lang", "draw")
        .agg(F.min("text").alias("text"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
        .where(F.col("place") <= per_language)
        .select("lang", F.array_join(F.slice(w, (place + 1).cast("int"), TRAIN_WORDS), " ").alias("span"))
        .collect()
    )
    return sorted((r["span"], r["lang"]) for r in rows)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with ``_lang`` and ``_score`` behind them; only ``text`` is read for them."""
    lang_name, score_name, letter_name = fresh(docs.columns, "_lang", "_score", "_letter")
    if model is None:
        return docs.select("*", F.lit(UND).alias(lang_name), F.lit(0.0).alias(score_name))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for four languages, 64 MB at most
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_unused()
        model = shared.value
        k = len(model.languages)
        for batch in batches:
            text = batch.column(at)
            share, counts = np.zeros((batch.num_rows, k)), np.zeros(batch.num_rows, np.int64)
            for a, b in portions(utf8(text)[1], max(PORTION, CHAIN_BYTES // k)):
                chances, first = label_words(model, text.slice(a, b - a))
                counts[a:b] = np.diff(first)
                some = np.flatnonzero(counts[a:b])
                if len(some):
                    share[a + some] = np.add.reduceat(chances, first[some], axis=0, dtype=np.float64) / counts[a + some, None]
            best = share.argmax(1)
            known = (counts > 0) & batch.column(len(names)).to_numpy(zero_copy_only=False)
            lang = [model.languages[b] if ok else UND for b, ok in zip(best, known)]
            score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang), pa.array(score)], [*names, lang_name, score_name])
        release_unused()

    schema = docs.select("*", F.lit("").alias(lang_name), F.lit(0.0).alias(score_name)).schema
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("*", letter.alias(letter_name)).mapInArrow(run, schema)


def language_model(docs: DataFrame, seed: int = SEED) -> Model | None:
    return fit(training_sample(docs, seed), seed)


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_model(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(rows, model).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
