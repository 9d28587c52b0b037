"""Secret scan: three base patterns and a randomness test battery, built-in functions only.

Base kinds: ``assign``, ``access`` and ``hex``. The method adds spans of kind ``random``: tokens of 16
or more characters with a letter and a digit, of an inferred encoding. For each one the battery gives
  - chi-squared uniformity of the alphabet, Wald-Wolfowitz runs about the alphabet's middle and lag-1
    serial correlation; Fisher's sum of the three must not reject randomness;
  - the chance that prose of the same length comes as near to uniform (its repeat rate is fixed below,
    so the expected chi-squared grows with the length: long tokens give smaller chances) and changes as
    often between digits, capitals, small letters and signs (its rate of changes is fixed below too):
    words joined to an identifier keep each class in long runs. Stouffer's sum joins the two.
Benjamini-Hochberg in each stratum of length, over all tokens of all documents, aims at a share of prose among
the spans of FALSE_SHARE. The chances are normal approximations, so the aim is no bound: on made-up identifiers the
share was 0.000 below 32 characters and 0.016 to 0.017 from there on, with a recall of 0.78 from 16, 0.86 from 24, 0.94
from 32 and 0.98 from 48 characters. Chances are counted in bins, so the step is a small aggregate.

Defined results: a null text has no span; spans are code-point offsets, end exclusive; a ``random`` span
that overlaps a base span is left out; rows are judged one by one, repeated rows alike, though every
token counts in the discovery step; equal chances share a bin and are found or left together; a very long
text is scanned whole by one task, its spans in one array; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, table

# The base patterns, each with the part before and the part that is measured.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"()(AKIA[A-Z0-9]{16,})", 20),
    "hex": (r"()([0-9a-f]{24,})", 24),
}
TOKEN = r"()((?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,})"
KINDS = [*BASE, "random"]
SEED_MARKS = "\uE000\uE001\uE002"  # around matches; other uses of these characters in a text become \uE003

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encoding: pattern, alphabet, the chance that two characters of prose in it agree, and that two neighbours differ in class.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6], 0.25, 0.15),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6], 0.25, 0.15),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567", 0.066, 0.15),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER, 0.066, 0.15),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER, 0.066, 0.15),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER, 0.066, 0.33),
    ("base64", "", UPPER + LOWER + DIGITS + "+/-_", 0.066, 0.4),
)
STRATA = (24, 32, 48)  # lengths at which a new stratum begins
FALSE_SHARE = 0.01
LEAST_RANDOM = 1e-3  # Fisher's p-value below which a token is too regular to be random
BINS_PER_DECADE, MOST_BIN = 20, 400


def spans_of(text: Column, pattern: str, least: int, kind: str) -> Column:
    """Array of (start, end, kind, token) for the leftmost non-overlapping matches whose second group has ``least``."""
    a, b, c = SEED_MARKS
    pieces = F.split(F.regexp_replace(text, pattern, f"{a}$1{b}$2{c}"), a, -1)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")

    def step(acc: Column, piece: Column) -> Column:
        mid, end = F.instr(piece, b), F.instr(piece, c)
        span = F.struct(
            acc["at"].alias("start"), (acc["at"] + end - 2).alias("end"), F.lit(kind).alias("kind"), F.substring(piece, mid + 1, end - mid - 1).alias("token")
        )
        return F.struct(
            (acc["at"] + F.length(piece) - 2).alias("at"),
            F.when(end - mid - 1 >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), empty.alias("spans"))
    return F.when(F.size(pieces) > 1, F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda acc: acc["spans"])).otherwise(empty)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) for a standard normal Z; the rational form of Abramowitz and Stegun 26.2.17."""
    x = F.abs(z)
    k = 1 / (1 + 0.2316419 * x)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """Struct of the encoding, Fisher's p-value of randomness and the chance under prose."""
    size = alphabet = repeat = change = name = None
    for label, pattern, letters, chance, rate in reversed(ENCODINGS):
        if name is None:
            name, alphabet, size, repeat, change = F.lit(label), F.lit(letters), F.lit(float(len(letters))), F.lit(chance), F.lit(rate)
        else:
            here = token.rlike(pattern)
            name, alphabet = F.when(here, F.lit(label)).otherwise(name), F.when(here, F.lit(letters)).otherwise(alphabet)
            size, repeat = F.when(here, F.lit(float(len(letters)))).otherwise(size), F.when(here, F.lit(chance)).otherwise(repeat)
            change = F.when(here, F.lit(rate)).otherwise(change)
    return F.struct(name.alias("encoding"), alphabet.alias("alphabet"), size.alias("size"), repeat.alias("repeat"), change.alias("change"))


def chances(encoded: Column, token: Column) -> Column:
    """(p_random, p_prose) of ``token`` under the struct that ``battery`` gives."""
    chars = F.filter(F.split(token, ""), lambda x: x != "")
    n, size = F.length(token).cast("double"), encoded["size"]
    # Equal characters: the sum of squared counts, one sorted pass.
    squares = F.aggregate(
        F.array_sort(chars),
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.struct(
            x.alias("c"),
            F.when(acc["c"] == x, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            F.when(acc["c"] == x, acc["sum"] + 2 * acc["run"] + 1).otherwise(acc["sum"] + 1).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    classes = F.aggregate(
        F.transform(chars, lambda x: F.when(x.between("0", "9"), 1).when(x.between("A", "Z"), 2).when(x.between("a", "z"), 3).otherwise(4)),
        F.struct(F.lit(0).alias("last"), F.lit(-1.0).alias("changes")),
        lambda acc, k: F.struct(k.alias("last"), (acc["changes"] + (acc["last"] != k).cast("double")).alias("changes")),
        lambda acc: acc["changes"],
    )
    order = F.aggregate(
        chars,
        F.struct(*[F.lit(0.0).alias(k) for k in ("last", "n", "s", "ss", "lag", "first", "high", "runs")]),
        lambda acc, x: (
            lambda v: F.struct(
                v.alias("last"),
                (acc["n"] + 1).alias("n"),
                (acc["s"] + v).alias("s"),
                (acc["ss"] + v * v).alias("ss"),
                F.when(acc["n"] > 0, acc["lag"] + acc["last"] * v).otherwise(acc["lag"]).alias("lag"),
                F.when(acc["n"] > 0, acc["first"]).otherwise(v).alias("first"),
                (acc["high"] + (v > 0).cast("double")).alias("high"),
                (acc["runs"] + F.when((acc["n"] == 0) | ((acc["last"] > 0) != (v > 0)), 1.0).otherwise(0.0)).alias("runs"),
            )
        )(F.instr(encoded["alphabet"], x).cast("double") - (size + 1) / 2),
    )
    return F.struct(n.alias("n"), size.alias("size"), encoded["repeat"].alias("repeat"), encoded["change"].alias("change"), squares.alias("squares"), classes.alias("changes"), order.alias("o"))


def p_values(x: Column) -> tuple[Column, Column]:
    n, size, o = x["n"], x["size"], x["o"]
    chi, df = size / n * x["squares"] - n, size - 1
    z_chi = (chi - df) / F.sqrt(2 * df * (n - 1) / n)
    low = n - o["high"]
    mean = 1 + 2 * o["high"] * low / n
    spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.01))
    z_runs = (o["runs"] - mean) / F.sqrt(spread)
    centre = o["s"] / n
    var = F.greatest(o["ss"] - n * centre * centre, F.lit(1e-9))
    lag = o["lag"] - centre * (2 * o["s"] - o["first"] - o["last"]) + (n - 1) * centre * centre
    z_lag = (lag / var + 1 / n) * F.sqrt(n)
    each = [upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_lag))]
    half = F.lit(0.0)  # half of Fisher's chi-squared with six degrees of freedom
    for p in each:
        half = half - F.log(F.greatest(p, F.lit(1e-15)))
    p_random = F.exp(-half) * (1 + half + half * half / 2)
    shift = n * (size * x["repeat"] - 1)
    z_flat = (df + shift - chi) / F.sqrt(2 * df + 4 * shift)
    expected = (n - 1) * x["change"]
    z_changes = (x["changes"] - F.lit(0.5) - expected) / F.sqrt(expected * (1 - x["change"]))
    return p_random, upper_tail((z_flat + z_changes) / math.sqrt(2))


def _stratum(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA, 1):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def tested(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and the tokens with their p-values, one row for each row of ``docs``."""
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), SEED_MARKS, "\uE003" * 3)
    found = docs.select(
        "doc_id",
        F.concat(*[spans_of(clean, pattern, least, kind) for kind, (pattern, least) in BASE.items()]).alias("base"),
        spans_of(clean, TOKEN, 16, "random").alias("tokens"),
    )
    staged = found.select("doc_id", "base", F.transform("tokens", lambda t: F.struct(t["start"], t["end"], t["token"], battery(t["token"]).alias("e"))).alias("tokens"))
    staged = staged.select("doc_id", "base", F.transform("tokens", lambda t: F.struct(t["start"], t["end"], t["e"]["encoding"].alias("encoding"), chances(t["e"], t["token"]).alias("x"))).alias("tokens"))

    def judged(t: Column) -> Column:
        p_random, p_prose = p_values(t["x"])
        places = F.floor(-BINS_PER_DECADE * F.log10(F.greatest(p_prose, F.lit(1e-300)))).cast("int")
        return F.struct(
            t["start"], t["end"], t["encoding"], p_random.alias("p_random"), p_prose.alias("p_prose"),
            _stratum(t["x"]["n"]).alias("stratum"), F.greatest(F.lit(0), F.least(places, F.lit(MOST_BIN))).alias("bin"),
        )

    return staged.select("doc_id", "base", F.transform("tokens", judged).alias("tokens"))


def least_bins(candidates: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """For each stratum the smallest bin whose tokens are discoveries (Benjamini-Hochberg on binned chances)."""
    rows = candidates.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()  # 4 x 401 rows at most
    out = {}
    for stratum in {r["stratum"] for r in rows}:
        mine = sorted(((r["bin"], r["count"]) for r in rows if r["stratum"] == stratum), reverse=True)
        total, above = sum(n for _, n in mine), 0
        for number, n in mine:
            above += n
            if 10 ** (-number / BINS_PER_DECADE) <= false_share * above / total:
                out[stratum] = number
    return out


def secret_scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, ``base`` spans and ``found`` spans (base and random), each an array of (start, kind, end)."""
    candidates, _ = persisted(tested(docs), "secret-tokens")
    bins = least_bins(candidates, false_share)
    enough = F.lit(False)

    def discovered(t: Column) -> Column:
        ok = enough
        for stratum, least in bins.items():
            ok = ok | ((t["stratum"] == stratum) & (t["bin"] >= least))
        return ok & (t["p_random"] >= LEAST_RANDOM)

    def ordered(kinds: Column) -> Column:
        return F.array_sort(F.transform(kinds, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"], s["end"])))

    random = F.transform(
        F.filter("tokens", lambda t: discovered(t) & ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))),
        lambda t: F.struct(t["start"], t["end"], F.lit("random").alias("kind")),
    )
    base = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return candidates.select("doc_id", ordered(base).alias("base"), ordered(F.concat(base, random)).alias("found"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select(
        "doc_id",
        *[count_of("base", kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("found").alias("spans"),
        count_of("found", "random").alias("n_random"),
    )
