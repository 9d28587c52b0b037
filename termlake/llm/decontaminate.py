"""Benchmark decontamination by template canonicalisation, built-in functions only.

Numbers, units after numbers and names become typed placeholders. Windows of WINDOW template tokens of
benchmark items and documents meet in a hash join. A window without any word keeps its literal values: a
bare row of numbers is no template.

A name is a capitalised word inside a sentence; one at the start of a sentence, a line, a quote or a bracket unless
it is a common word; and, in small letters or capitals, a word that is a name in the benchmark, so that a copy in
other case still matches. Common are words that the benchmark writes small more often than as names inside
sentences, names in the benchmark its other capitalised words. Up to MOST_WORDS of each stand in the plan; of more
words, tokens meet them in a join. So a word is judged alike in items and in documents, by its place alone.

A document leaks an item if consistent windows cover MIN_COVERAGE of the item's windows:
  - a window that stands once in its item meets on diagonals (document, item, shift). On a diagonal every
    value of the item stands for one value of the document and the other way round, so that a
    re-parameterised question still matches; the windows with a slot that disagrees are dropped;
  - windows that repeat inside the item, or hold no word, are counted: as many as the document has of them,
    with slots that agree inside the window, but no more than the item has.

Pass 1 joins the windows of all documents with the rarest windows of each item only: to reach the
coverage a document must hold one of these, so windows that many items share make no candidates. Pass 2
tokenises the candidate documents again and joins by (document, window), so a window that is common in
documents or in items meets its candidates only.

Defined results: null and empty texts have no window; an item of fewer than WINDOW tokens has one window,
all its tokens, and is met at any place of a document; rows with the same doc_id and text are one document,
a null doc_id is an id like others; an empty benchmark or an empty table leaks nothing; benchmark rows that
share an item_id are windows of one item; a very long text is a row for each window of six tokens, in both
passes, and no group holds more than an item's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, fresh, persisted, table

WINDOW = 6
MIN_COVERAGE = 0.4
MOST_BROADCAST = 1_000_000  # rows of three or four longs: a broadcast stays under 200 MB
MOST_WORDS = 20_000  # stand in the plan as a hash set; more are joined
NUMBER_MARK, NAME_MARK, UNIT_MARK, AFTER_MARKS, START_MARK = "\uE011", "\uE012", "\uE013", "\uE014", "\uE015"

# Units of measure, money and time that may follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters litre litres "
    "gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents pound pounds percent degree degrees kph mph hz khz mhz ghz kb mb gb tb w kw kwh v"
).split()
NUMBER = r"(\p{N}+(?:[.,:/]\p{N}+)*)"
NUMBER_UNIT = NUMBER + r"(?:\x20?(?i:(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])))?"
NAME = r"(?<=[\p{Ll}\p{N},;]\x20)(\p{Lu}[\p{L}']*)"
START = rf"(?<![\p{{L}}\p{{M}}\p{{N}}'{NAME_MARK}])(\p{{Lu}}[\p{{Ll}}'][\p{{L}}']*)"
SMALL = r"(?<![\p{L}\p{M}'])\p{Ll}[\p{L}\p{M}']*"
TOKEN = rf"{NUMBER_MARK}\p{{N}}+(?:[.,:/]\p{{N}}+)*|[{NAME_MARK}{UNIT_MARK}{START_MARK}]?[\p{{L}}\p{{M}}']+"


def known_words(benchmark: DataFrame) -> tuple[list[str], list[str]] | DataFrame:
    """The words that items write small more often than as names inside sentences, and all others that they write with a capital.

    Two lists, or a table (word, common) if either is longer than MOST_WORDS.
    """

    def found(pattern: str, group: int, small: int) -> DataFrame:
        words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(group))
        return benchmark.select(F.explode(words).alias("word"), F.lit(small).alias("small"))

    words = found(SMALL, 0, 1).unionByName(found(NAME, 1, -1)).unionByName(found(START, 1, 0))
    table, path = persisted(words.groupBy(F.lower("word").alias("word")).agg((F.sum("small") > 0).alias("common")), "bench-words")
    if any(r["count"] > MOST_WORDS for r in table.groupBy("common").count().collect()):
        return table
    lists = tuple([r["word"] for r in table.where(test).collect()] for test in ("common", "NOT common"))
    drop_path(benchmark.sparkSession, path)
    return lists


def template_tokens(text: Column) -> Column:
    """Lower-case tokens; placeholders begin with the mark of their type, and the literal value follows."""
    plain = F.translate(F.coalesce(text, F.lit("")), NUMBER_MARK + NAME_MARK + UNIT_MARK + START_MARK, "    ")
    named = F.regexp_replace(F.regexp_replace(plain, NAME, NAME_MARK + "$1"), START, START_MARK + "$1")
    marked = F.regexp_replace(named, NUMBER_UNIT, f" {NUMBER_MARK}$1 {UNIT_MARK}$2 ")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def decided(tokens: str, words: tuple[list[str], list[str]] = ([], [])) -> Column:
    """The column ``tokens`` with words and names told apart. It's SQL text, as thousands of single literals take seconds to build."""
    common, names = ("(" + (", ".join("'" + w.replace("'", "\\'") + "'" for w in known) or "NULL") + ")" for known in words)
    word = "substring(t, 2)"
    return F.expr(f"""transform({tokens}, t -> CASE WHEN startswith(t, '{START_MARK}') THEN if({word} IN {common}, {word}, concat('{NAME_MARK}', {word}))
                      WHEN t IN {names} THEN concat('{NAME_MARK}', t) ELSE t END)""")


def decided_by_join(texts: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """As ``decided`` for a table of words (word, common): tokens are rows that meet their words, and texts are put together again."""
    tokens = texts.select(*keys, "_w", F.monotonically_increasing_id().alias("_row")).select(*keys, "_row", F.posexplode("_w").alias("_at", "_token"))
    start = F.col("_token").startswith(START_MARK)
    bare = F.when(start, F.expr("substring(_token, 2)")).otherwise(F.col("_token"))
    met = tokens.join(few(known), bare == F.col("word"), "left")
    name = F.when(start, F.coalesce(~F.col("common"), F.lit(True))).otherwise(F.coalesce(~F.col("common"), F.lit(False)))
    token = F.when(name, F.concat(F.lit(NAME_MARK), bare)).otherwise(bare)
    whole = met.groupBy(*keys, "_row").agg(F.array_sort(F.collect_list(F.struct("_at", token.alias("token")))).alias("_w"))
    return whole.select(*keys, F.col("_w.token").alias("_w"))


def is_slot(token: Column) -> Column:
    return (token >= NUMBER_MARK) & (token < AFTER_MARKS)


def windows(texts: DataFrame, keys: list[str], sizes: Column, window: int = WINDOW, words: tuple[list[str], list[str]] | DataFrame = ([], [])) -> DataFrame:
    """One row for each window: the keys, its place ``at``, its ``size``, ``hash``, ``wordless`` and its tokens ``toks``.

    ``sizes``: array of the sizes of windows of the tokens ``_w``, at most ``window`` each. The places are
    exploded, so hashing and the join that follows run in generated code; a row holds its own tokens only.
    """
    typed = F.transform("_w", lambda t: F.when(is_slot(t), F.substring(t, 1, 1)).otherwise(t))
    at, size = F.col("at"), F.col("size")
    types, toks = F.slice("_t", at + 1, size), F.slice("_w", at + 1, size)
    tokens = texts.withColumn("_w", template_tokens(F.col("text")))
    tokens = decided_by_join(tokens, keys, words) if isinstance(words, DataFrame) else tokens.withColumn("_w", decided("_w", words))
    return (
        tokens.select(*keys, "_w", F.explode(sizes).alias("size"))
        .where((size > 0) & (size <= F.size("_w")))  # above the explode, so that texts are taken apart once
        .select(*keys, "_w", typed.alias("_t"), "size")
        .select(*keys, "_w", "_t", "size", F.explode(F.sequence(F.lit(0), F.size("_w") - size)).alias("at"))
        .select(*keys, "_w", "_t", "size", "at", ((F.array_min(types) >= NUMBER_MARK) & (F.array_max(types) < AFTER_MARKS)).alias("wordless"))
        .select(*keys, "at", "size", "wordless", F.when(F.col("wordless"), F.xxhash64(toks)).otherwise(F.xxhash64(types)).alias("hash"), toks.alias("toks"))
    )


def pattern_of(tokens: Column) -> Column:
    """Which slots of a window hold equal values: the place of each slot's first equal, 0 for a word."""
    return F.array_join(F.transform(tokens, lambda t: F.when(is_slot(t), F.array_position(tokens, t)).otherwise(F.lit(0))), ",", "-")


def repeated_values(values: Column) -> Column:
    """The values that stand more than once in an array: those of slots that disagree."""
    ordered = F.array_sort(values)
    return F.array_distinct(F.filter(ordered, lambda v, i: (i > 0) & (F.get(ordered, i - 1) == v)))


def few(df: DataFrame) -> DataFrame:
    """``df`` (rows of a few numbers), to be broadcast if it has at most MOST_BROADCAST rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def anchors(item_windows: DataFrame, min_coverage: float = MIN_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(item_id, n_windows) and (hash, size, item_id) of the windows of which a leak meets one at least.

    An item with n windows needs need = ceil(n * min_coverage) of them, so one of any n - need + 1. Those held by
    the fewest items are taken.
    """
    held = item_windows.groupBy("hash", "size").agg(F.countDistinct("item_id").alias("items"))
    ranked = item_windows.join(held, ["hash", "size"]).select(
        "item_id", "hash", "size",
        F.count("*").over(Window.partitionBy("item_id")).alias("n_windows"),
        F.row_number().over(Window.partitionBy("item_id").orderBy("items", "hash", "at")).alias("place"),
    )
    spare = F.col("n_windows") - F.greatest(F.ceil(F.col("n_windows") * F.lit(min_coverage) - 1e-9), F.lit(1)) + 1
    return ranked.select("item_id", "n_windows").distinct(), ranked.where(F.col("place") <= spare).select("hash", "size", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, text hash ``_th``, item_id, coverage and n_slots of every leak of an item into a document."""
    bench = benchmark.select("item_id", F.col("text"))
    words = known_words(bench)
    item_windows, _ = persisted(
        windows(bench, ["item_id"], F.array(F.least(F.size("_w"), F.lit(window))), window, words)
        .withColumn("pattern", pattern_of(F.col("toks")))
        .withColumn("single", ~F.col("wordless") & (F.count("*").over(Window.partitionBy("item_id", "hash", "size")) == 1)),
        "bench-windows",
    )
    sizes, rare = anchors(item_windows, min_coverage)
    short = [r["size"] for r in item_windows.where(F.col("size") < window).select("size").distinct().collect()]  # fewer than ``window``
    asked = F.array(*map(F.lit, [window, *sorted(short)]))

    texts = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("_th"))
    rare, rare_path = persisted(rare, "bench-anchors")
    candidates, _ = persisted(
        windows(texts, ["doc_id", "_th"], asked, window, words).select("doc_id", "_th", "hash", "size").join(few(rare), ["hash", "size"]).select("doc_id", "_th", "item_id").distinct(),
        "bench-candidates",
    )
    drop_path(docs.sparkSession, rare_path)

    def same_doc(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._th") == F.col(f"{b}._th"))

    def asked_for(theirs: DataFrame) -> DataFrame:
        """(doc_id, _th) and the windows of the items it is a candidate for."""
        return candidates.join(theirs, "item_id")

    wanted = few(candidates.select("doc_id", "_th").distinct())
    again = texts.alias("t").join(wanted.alias("c"), same_doc("t", "c"), "left_semi").dropDuplicates(["doc_id", "_th"])
    met = windows(again, ["doc_id", "_th"], asked, window, words)
    single = asked_for(item_windows.where("single").select("item_id", "hash", "size", F.col("at").alias("item_at"), F.col("toks").alias("item_toks")))
    hits = met.alias("d").join(single.alias("i"), same_doc("d", "i") & (F.col("d.hash") == F.col("i.hash")) & (F.col("d.size") == F.col("i.size"))).select(
        "d.doc_id", "d._th", "i.item_id", "i.item_at", (F.col("d.at") - F.col("i.item_at")).alias("shift"),
        F.filter(F.arrays_zip(F.col("i.item_toks").alias("item"), F.col("d.toks").alias("doc")), lambda p: is_slot(p["item"])).alias("slots"),
    )
    diagonals = (  # a group holds at most one row for each of the item's windows
        hits.groupBy("doc_id", "_th", "item_id", "shift")
        .agg(F.collect_set(F.struct("item_at", "slots")).alias("places"))
        .withColumn("slots", F.array_distinct(F.flatten("places.slots")))
        .withColumns({side: repeated_values(F.col(f"slots.{side}")) for side in ("item", "doc")})
        .withColumn("places", F.filter("places", lambda p: ~F.exists(p["slots"], lambda s: F.array_contains("item", s["item"]) | F.array_contains("doc", s["doc"]))))
        .where(F.size("places") > 0)
        .select("doc_id", "_th", "item_id", F.explode("places.item_at").alias("item_at"), F.size(F.array_distinct(F.flatten("places.slots"))).alias("n_slots"))
        .groupBy("doc_id", "_th", "item_id", "item_at")
        .agg(F.max("n_slots").alias("n_slots"))
        .groupBy("doc_id", "_th", "item_id")
        .agg(F.count("*").alias("met"), F.max("n_slots").alias("n_slots"))
    )
    kinds = item_windows.where("NOT single").groupBy("item_id", "hash", "size", "pattern").agg(F.count("*").alias("most"))
    counted = met.select("doc_id", "_th", "hash", "size", pattern_of(F.col("toks")).alias("pattern")).groupBy("doc_id", "_th", "hash", "size", "pattern").agg(F.count("*").alias("n"))
    on = same_doc("d", "i")
    for name in ("hash", "size", "pattern"):
        on = on & (F.col(f"d.{name}") == F.col(f"i.{name}"))
    repeats = counted.alias("d").join(asked_for(kinds).alias("i"), on).select("d.doc_id", "d._th", "i.item_id", F.least("d.n", "i.most").alias("met"), F.lit(0).alias("n_slots"))
    return (
        diagonals.unionByName(repeats)
        .groupBy("doc_id", "_th", "item_id")
        .agg(F.sum("met").alias("met"), F.max("n_slots").alias("n_slots"))
        .join(sizes, "item_id")
        .withColumn("coverage", F.col("met") / F.col("n_windows"))
        .where(F.col("coverage") >= min_coverage)
        .select("doc_id", "_th", "item_id", "coverage", "n_slots")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; up to MOST_BROADCAST leaking rows the table is not shuffled."""
    bad_id, bad_th = fresh(docs.columns, "_bad_id", "_bad_th")
    found, _ = persisted(leaks(docs, benchmark).select(F.col("doc_id").alias(bad_id), F.col("_th").alias(bad_th)).distinct(), "bench-leaks")
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_th))
    return docs.join(few(found), same, "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.col("n_slots").cast("bigint").alias("n_slots")).distinct()
