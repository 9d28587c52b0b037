"""Resolution of names and values: exact before derived, and a refusal rather than a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name, without_suffix, zero_pad
from ..sources.shared import stored
from .similar import SimilarIndex, search

SIMILARITY_FLOOR = 0.55
CANDIDATES = 8
FEW = 1000  # names that stand in a plan, at most


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(alias in lower case, code) of the aliases that stand for exactly one code."""
    return (
        aliases.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("code").alias("codes"), F.min("code").alias("code")).where("codes = 1").select("alias", "code")
    )


def resolve_ladder(asked: DataFrame, concepts: DataFrame, aliases: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """raw, code and method of each asked value: exact label, unique alias, most similar label from the floor up, else refused.

    ``similar`` has raw, code and similarity of the candidates.
    """
    exact = concepts.groupBy(F.lower("label").alias("_l")).agg(F.min("code").alias("exact_code"))
    alias = unique_aliases(aliases).select(F.col("alias").alias("_a"), F.col("code").alias("alias_code"))
    key = F.lower(F.trim("raw"))
    out = asked.join(exact, key == F.col("_l"), "left").join(alias, key == F.col("_a"), "left")
    if similar is not None:
        ranked = similar.withColumn("rn", F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("similarity"), "code")))
        best = ranked.where("rn = 1").select("raw", F.col("code").alias("near_code"), "similarity")
        out = out.join(best, "raw", "left")
    else:
        out = out.withColumn("near_code", F.lit(None).cast("string")).withColumn("similarity", F.lit(None).cast("double"))
    near = F.col("similarity") >= SIMILARITY_FLOOR
    method = (
        F.when(F.col("exact_code").isNotNull(), "exact").when(F.col("alias_code").isNotNull(), "alias").when(near, "embedding").otherwise("refused")
    )
    return out.select("raw", F.coalesce("exact_code", "alias_code", F.when(near, F.col("near_code"))).alias("code"), method.alias("method"))


def resolve_values(asked: DataFrame, concepts: DataFrame, aliases: DataFrame, index: SimilarIndex, most: int = CANDIDATES) -> DataFrame:
    """The whole ladder for ``asked`` (raw, vector): raw, code, method, similarity, and what a refused value could have meant.

    Only values that are neither a label nor an alias go to the similarity search, each once. ``similarity`` is that of
    the most similar code, ``candidates`` the ``most`` nearest codes of a refused value in order, and both are NULL
    where nothing was searched; a value without a vector is refused without candidates.
    """
    direct = resolve_ladder(asked.select("raw"), concepts, aliases)
    unresolved = asked.join(direct.where("method = 'refused'").select("raw").distinct(), "raw", "left_semi").where(F.col("vector").isNotNull())
    found, _ = stored(search(index, unresolved.select("raw", "vector"), most), "similar-found")
    ladder = resolve_ladder(asked.select("raw"), concepts, aliases, found.where("rank = 1"))
    near = found.groupBy("raw").agg(F.max("similarity").alias("similarity"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("candidates"))
    refused = F.when(F.col("method") == "refused", F.col("candidates")).alias("candidates")
    return ladder.join(near, "raw", "left").select("raw", "code", "method", "similarity", refused)


def longest_prefix(rows: DataFrame, prefixes: DataFrame, column: str = "sic", lengths: tuple[int, ...] = (4, 3, 2), width: int = 4) -> DataFrame:
    """``rows`` with ``prefix_code``, the code of the longest prefix that is known: one equi-join per length."""
    out = rows.withColumn("_digits", zero_pad(F.trim(column), width))
    known = prefixes.groupBy("prefix").agg(F.min("code").alias("code"))
    for k in lengths:
        out = out.join(known.select(F.col("prefix").alias(f"_p{k}"), F.col("code").alias(f"_c{k}")), F.left("_digits", F.lit(k)) == F.col(f"_p{k}"), "left")
    out = out.withColumn("prefix_code", F.coalesce(*[F.col(f"_c{k}") for k in lengths]))
    return out.drop("_digits", *[f"_{x}{k}" for k in lengths for x in "pc"])


def resolve_names(rows: DataFrame, index: DataFrame, column: str = "name") -> DataFrame:
    """``rows`` with ``cik``: the normalised name's entry, else that of the name without its legal suffix."""
    full = rows.withColumn("_full", normalize_name(F.col(column))).withColumn("_short", without_suffix(F.col("_full")))
    i1, i2 = index.select(F.col("name").alias("_n1"), F.col("cik").alias("_k1")), index.select(F.col("name").alias("_n2"), F.col("cik").alias("_k2"))
    found = full.join(i1, F.col("_full") == F.col("_n1"), "left").join(i2, F.col("_short") == F.col("_n2"), "left")
    return found.withColumn("cik", F.coalesce("_k1", "_k2")).drop("_full", "_short", "_n1", "_n2", "_k1", "_k2")


def first_resolving(rows: DataFrame, lookup: DataFrame, key: str = "id", names: str = "names") -> DataFrame:
    """Per row the first of its ordered candidate names that ``lookup`` (name, attribute) gives an attribute; of several attributes the least.

    Up to FEW names stand in the plan and rows stay where they are; more names are joined.
    """
    known = lookup.where(F.col("name").isNotNull() & F.col("attribute").isNotNull()).groupBy("name").agg(F.min("attribute").alias("attribute"))
    held = known.limit(FEW + 1).collect()
    if len(held) <= FEW:
        none = F.lit(None).cast(dict(known.dtypes)["attribute"])
        first = rows.select(key, F.get(F.filter(names, lambda n: n.isin([r["name"] for r in held])), F.lit(0)).alias("name"))
        pairs = F.create_map(*[F.lit(x) for r in held for x in (r["name"], r["attribute"])]) if held else None
        return first.select(key, "name", (none if pairs is None else pairs[F.col("name")]).alias("attribute"))
    row = F.monotonically_increasing_id().alias("_row")
    numbered, _ = stored(rows.select(key, F.col(names).alias("_names"), row), "resolving-rows")
    hits = numbered.select("_row", F.posexplode("_names").alias("pos", "name")).join(known.select("name"), "name", "left_semi")
    at = hits.groupBy("_row").agg(F.min("pos").alias("pos"))  # numbers only, so that the groups need no sort
    first = numbered.join(at, "_row", "left").select(key, F.get("_names", F.col("pos")).alias("name"))
    return first.join(known, "name", "left").select(key, "name", "attribute")
