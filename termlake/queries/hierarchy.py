"""Hierarchy and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..operators import hierarchy as h
from ..operators import resolve as r
from ..operators import similar
from ..sources import tables as t
from ..sources.tables import sql_with

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str, recursive: bool = False):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql, recursive=recursive) if views else sql
        return f

    return wrap


@register("hier_descendants", """
, d(root, code, depth) AS (
  SELECT code, code, 0 FROM concepts WHERE level = 1 UNION ALL SELECT d.root, c.code, d.depth + 1 FROM d JOIN concepts c ON c.parent_code = d.code
) SELECT root, code, depth FROM d""", "concepts", recursive=True)
def hier_descendants(spark, sf_dir):
    c = t.concepts(spark, sf_dir)
    return h.descendants(c, c.where("level = 1"))


@register("hier_ancestors", """
, a(code, ancestor, up) AS (
  SELECT code, code, 0 FROM concepts WHERE level = 3 UNION ALL SELECT a.code, c.parent_code, a.up + 1 FROM a JOIN concepts c ON c.code = a.ancestor WHERE c.parent_code IS NOT NULL
) SELECT code, ancestor, CAST(max(up) OVER (PARTITION BY code) - up + 1 AS INT) AS position FROM a""", "concepts", recursive=True)
def hier_ancestors(spark, sf_dir):
    c = t.concepts(spark, sf_dir)
    return h.ancestors(c, c.where("level = 3"))


@register("hier_intervals", """
, d(root, code, depth) AS (
  SELECT code, code, 0 FROM concepts UNION ALL SELECT d.root, c.code, d.depth + 1 FROM d JOIN concepts c ON c.parent_code = d.code
) SELECT a.code, a.root, a.depth, b.below FROM d a JOIN (SELECT code FROM concepts WHERE parent_code IS NULL) r ON r.code = a.root
JOIN (SELECT root, count(*) - 1 AS below FROM d GROUP BY root) b ON b.root = a.code""", "concepts", recursive=True)
def hier_intervals(spark, sf_dir):
    """Tree, depth and number of nodes below each node, all read from its interval."""
    below = F.floor((F.col("high") - F.col("low") - 1) / 2).alias("below")
    return h.intervals(t.concepts(spark, sf_dir)).select("code", "root", "depth", below)


@register("hier_inside", """
SELECT m.id, m.industry_code FROM matters m JOIN concepts c ON c.code = m.industry_code WHERE 'R3' IN (c.code, c.level_1_code, c.level_2_code, c.level_3_code)""", "matters", "concepts")
def hier_inside(spark, sf_dir):
    """Entities below a node by the range test of its interval."""
    below = h.inside(h.intervals(t.concepts(spark, sf_dir)), "R3").select(F.col("code").alias("industry_code"))
    return t.matters(spark, sf_dir).join(below, "industry_code", "left_semi").select("id", "industry_code")


@register("hier_ancestry", """
SELECT code, label, parent_code, level, level_1_code, level_2_code, level_3_code FROM concepts""", "concepts")
def hier_ancestry(spark, sf_dir):
    c = t.concepts(spark, sf_dir).select("code", "label", "parent_code")
    edges = c.where("parent_code IS NOT NULL").select("code", "parent_code")
    return h.flattened(c, edges, c.select("code").where("false"))


@register("hier_rollup_filter", """
SELECT m.id, m.industry_code FROM matters m JOIN concepts c ON c.code = m.industry_code WHERE 'R2' IN (c.code, c.level_1_code, c.level_2_code, c.level_3_code)""", "matters", "concepts")
def hier_rollup_filter(spark, sf_dir):
    return h.under(t.matters(spark, sf_dir), t.concepts(spark, sf_dir), "R2").select("id", "industry_code")


@register("hier_exclude_subtree", """
SELECT code FROM concepts c WHERE c.label LIKE 'ASIA%' OR c.label LIKE 'UNITED%' OR c.level_1_code IN (SELECT code FROM concepts WHERE label LIKE 'ASIA%')
   OR c.level_2_code IN (SELECT code FROM concepts WHERE label LIKE 'UNITED%')""", "concepts")
def hier_exclude_subtree(spark, sf_dir):
    c = t.concepts(spark, sf_dir).select("code", "label", "parent_code")
    return h.excluded_subtree(c, c.select("code", "parent_code"), ("ASIA", "UNITED"))


@register("alias_unique", "SELECT lower(alias) AS alias, min(code) AS code FROM aliases GROUP BY 1 HAVING count(DISTINCT code) = 1", "aliases")
def alias_unique(spark, sf_dir):
    return r.unique_aliases(t.aliases(spark, sf_dir))


ASKED = ["France", " germany ", "nation 3", "group 1", "no such place", "Nation 24", "EUROPE"]


@register("resolve_ladder", f""", asked AS (SELECT * FROM (VALUES {", ".join(f"('{a}')" for a in ASKED)}) v(raw)),
ex AS (SELECT lower(label) AS k, min(code) AS code FROM concepts GROUP BY 1), al AS (SELECT lower(alias) AS k, min(code) AS code FROM aliases GROUP BY 1 HAVING count(DISTINCT code) = 1)
SELECT raw, coalesce(ex.code, al.code) AS code, CASE WHEN ex.code IS NOT NULL THEN 'exact' WHEN al.code IS NOT NULL THEN 'alias' ELSE 'refused' END AS method
FROM asked LEFT JOIN ex ON ex.k = lower(trim(raw)) LEFT JOIN al ON al.k = lower(trim(raw))""", "concepts", "aliases")
def resolve_ladder(spark, sf_dir):
    asked = spark.createDataFrame([(a,) for a in ASKED], "raw string")
    return r.resolve_ladder(asked, t.concepts(spark, sf_dir), t.aliases(spark, sf_dir))


@register("resolve_similar", """
SELECT raw, code, round(similarity, 6) AS similarity, rank FROM (
  SELECT raw, code, similarity, CAST(row_number() OVER (PARTITION BY raw ORDER BY similarity DESC, code) AS INT) AS rank
  FROM (SELECT CAST(a.vec_id AS VARCHAR) AS raw, b.vec_id AS code, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
        FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
) WHERE rank <= 8""")
def resolve_similar(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, against all vectors, by the index and exactly."""
    e = t.load(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("raw"), F.col("embedding").alias("vector"))
    found = similar.search(similar.build(e, code="vec_id"), asked)
    return found.select("raw", "code", F.round("similarity", 6).alias("similarity"), "rank")


# What customers call themselves: a label in other case, an alias, an ambiguous alias, a name that only a vector knows.
RAW = """CASE c_custkey % 4 WHEN 0 THEN concat('  ', lower(n_name), ' ') WHEN 1 THEN concat('Nation ', n_nationkey)
  WHEN 2 THEN concat('group ', n_regionkey) ELSE concat(c_name, ' ', c_custkey) END"""


@register("resolve_values", f""", asked AS (
  SELECT c_custkey, raw, CASE WHEN c_custkey % 4 = 3 THEN CAST(embedding AS DOUBLE[]) END AS vector
  FROM (SELECT c_custkey, {RAW} AS raw FROM customer JOIN nation ON n_nationkey = c_nationkey) LEFT JOIN embeddings ON vec_id = c_custkey
), ex AS (SELECT lower(label) AS k, min(code) AS code FROM concepts GROUP BY 1), al AS (SELECT lower(alias) AS k, min(code) AS code FROM aliases GROUP BY 1 HAVING count(DISTINCT code) = 1),
near AS (
  SELECT raw, code, similarity, row_number() OVER (PARTITION BY raw ORDER BY similarity DESC, code) AS rank
  FROM (SELECT raw, 'S' || s_suppkey AS code, round(list_cosine_similarity(vector, CAST(embedding AS DOUBLE[])), 9) AS similarity
        FROM asked, supplier JOIN embeddings ON vec_id = s_suppkey WHERE vector IS NOT NULL)
), best AS (SELECT raw, max(similarity) AS similarity, arg_min(code, rank) AS code, string_agg(code, '|' ORDER BY rank) FILTER (WHERE rank <= 8) AS candidates FROM near GROUP BY raw)
SELECT asked.raw, coalesce(ex.code, al.code, CASE WHEN similarity >= 0.55 THEN best.code END) AS code, round(similarity, 6) AS similarity,
       CASE WHEN ex.code IS NOT NULL THEN 'exact' WHEN al.code IS NOT NULL THEN 'alias' WHEN similarity >= 0.55 THEN 'embedding' ELSE 'refused' END AS method,
       CASE WHEN coalesce(similarity, 0) < 0.55 AND ex.code IS NULL AND al.code IS NULL THEN candidates END AS candidates
FROM (SELECT DISTINCT raw FROM asked) asked LEFT JOIN ex ON ex.k = lower(trim(asked.raw)) LEFT JOIN al ON al.k = lower(trim(asked.raw)) LEFT JOIN best ON best.raw = asked.raw""", "concepts", "aliases")
def resolve_values(spark, sf_dir):
    """All that customers call themselves, against labels, aliases and the vectors of the suppliers."""
    customer, nation, e = (t.load(spark, sf_dir, x) for x in ("customer", "nation", "embeddings"))
    named = customer.join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.expr(RAW).alias("raw"))
    vector = F.when(F.col("c_custkey") % 4 == 3, F.col("embedding"))
    asked = named.join(e, F.col("vec_id") == F.col("c_custkey"), "left").select("raw", vector.alias("vector")).dropDuplicates(["raw"])
    known = t.load(spark, sf_dir, "supplier").join(e, F.col("vec_id") == F.col("s_suppkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("code"), "embedding")
    found = r.resolve_values(asked, t.concepts(spark, sf_dir), t.aliases(spark, sf_dir), similar.build(known))
    return found.select("raw", "code", "method", F.round("similarity", 6).alias("similarity"), F.array_join("candidates", "|").alias("candidates"))


PREFIXES = [("00", "A"), ("001", "B"), ("0012", "C"), ("01", "D"), ("014", "E"), ("0199", "F"), ("02", "G")]
PREFIX_SQL = ", ".join(map(str, PREFIXES))


@register("prefix_longest_match", f""", p AS (SELECT * FROM (VALUES {PREFIX_SQL}) v(prefix, code)), k AS (SELECT l_partkey, lpad(CAST(l_partkey AS STRING), CAST(greatest(4, length(CAST(l_partkey AS STRING))) AS INT), '0') AS d FROM (SELECT DISTINCT l_partkey FROM lineitem))
SELECT l_partkey AS partkey, coalesce(a.code, b.code, c.code) AS code FROM k
LEFT JOIN p a ON a.prefix = left(d, 4) LEFT JOIN p b ON b.prefix = left(d, 3) LEFT JOIN p c ON c.prefix = left(d, 2)""", "aliases")
def prefix_longest_match(spark, sf_dir):
    rows = t.load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey")).distinct().withColumn("sic", F.col("partkey").cast("string"))
    found = r.longest_prefix(rows, spark.createDataFrame(PREFIXES, "prefix string, code string"))
    return found.select("partkey", F.col("prefix_code").alias("code"))


NAMES_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace({0}, '[^A-Za-z0-9 ]', ' ', 'g')), '\\bCOMPANY\\b', 'CO', 'g'), '\\bCORPORATION\\b', 'CORP', 'g'), ' +', ' ', 'g'))"


@register("normalize_name", "SELECT c_custkey, " + NAMES_SQL.format("c_name || ', Company of the Corporation'") + " AS name FROM customer")
def normalize(spark, sf_dir):
    return t.load(spark, sf_dir, "customer").select("c_custkey", normalize_name(F.concat("c_name", F.lit(", Company of the Corporation"))).alias("name"))


ENDINGS = "CASE s_suppkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', Corporation' WHEN 2 THEN ' Group' ELSE '' END"


@register("entity_resolve", f"""
WITH s AS (SELECT s_suppkey, s_nationkey, upper(regexp_replace(s_name, '[^A-Za-z0-9 ]', ' ', 'g')) AS bare FROM supplier),
idx AS (SELECT CASE WHEN s_nationkey % 2 = 0 THEN bare ELSE bare || ' INC' END AS name, s_suppkey FROM s),
n AS (SELECT s_suppkey, bare || CASE s_suppkey % 4 WHEN 0 THEN ' INC' WHEN 1 THEN ' CORP' WHEN 2 THEN ' GROUP' ELSE '' END AS f, CASE WHEN s_suppkey % 4 < 3 THEN bare END AS g FROM s)
SELECT n.s_suppkey AS suppkey, lpad(CAST(coalesce(a.s_suppkey, b.s_suppkey) AS STRING), 10, '0') AS cik FROM n LEFT JOIN idx a ON a.name = n.f LEFT JOIN idx b ON b.name = n.g""")
def entity_resolve(spark, sf_dir):
    s = t.load(spark, sf_dir, "supplier")
    suffix = F.when(F.col("s_nationkey") % 2 == 0, "").otherwise(", Incorporated")
    index = s.select(normalize_name(F.concat("s_name", suffix)).alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"))
    rows = s.select(F.col("s_suppkey").alias("suppkey"), F.concat("s_name", F.expr(ENDINGS)).alias("name"))
    return r.resolve_names(rows, index).select("suppkey", "cik")


@register("first_resolving_candidate", """
WITH n AS (SELECT o_orderkey AS id, [o_orderpriority, o_orderstatus, 'P'] AS names FROM orders), e AS (SELECT id, names[i] AS name, i FROM (SELECT id, names, unnest(range(1, 4)) AS i FROM n)),
hit AS (SELECT id, name, CASE name WHEN '2-HIGH' THEN 'high' WHEN 'F' THEN 'final' WHEN 'P' THEN 'pending' END AS attribute, i FROM e)
SELECT n.id, x.name, x.attribute FROM n LEFT JOIN (SELECT id, arg_min(name, i) AS name, arg_min(attribute, i) AS attribute FROM hit WHERE attribute IS NOT NULL GROUP BY id) x ON x.id = n.id""")
def first_resolving_candidate(spark, sf_dir):
    rows = t.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority", "o_orderstatus", F.lit("P")).alias("names"))
    lookup = spark.createDataFrame([("2-HIGH", "high"), ("F", "final"), ("P", "pending"), ("5-LOW", None)], "name string, attribute string")
    return r.first_resolving(rows, lookup)
