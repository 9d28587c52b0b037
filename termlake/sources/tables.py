"""Loaders of the star-schema tables and the four governed views derived from them.

``concepts`` (a three-level hierarchy), ``aliases`` (its ambiguous names), ``matters`` (entities) and
``deal_points`` (one row per entity and attribute, never pivoted). NULL means "not resolved".
``VIEW_SQL`` states the same views as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    none = F.lit(None).cast("string")
    r, n, s = (F.concat(F.lit(p), F.col(c)) for p, c in (("R", "r_regionkey"), ("N", "n_nationkey"), ("S", "s_suppkey")))
    n_parent, s_parent = F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), "s_nationkey")

    def level(df: DataFrame, code, label, parent, number, *levels) -> DataFrame:
        return df.select(
            code.alias("code"), F.col(label).alias("label"), parent.alias("parent_code"), F.lit(number).alias("level"),
            *[c.alias(f"level_{i}_code") for i, c in enumerate(levels, 1)],
        )

    top = level(region, r, "r_name", none, 1, r, none, none)
    middle = level(nation, n, "n_name", n_parent, 2, n_parent, n, none)
    nations = F.broadcast(nation.select("n_nationkey", "n_regionkey"))  # a dimension of fixed size
    low = level(supplier.join(nations, F.col("n_nationkey") == F.col("s_nationkey")), s, "s_name", s_parent, 3, n_parent, s_parent, s)
    return top.unionByName(middle).unionByName(low)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    code = F.concat(F.lit("N"), "n_nationkey").alias("code")
    own = nation.select(F.concat(F.lit("nation "), "n_nationkey").alias("alias"), code)
    return own.unionByName(nation.select(F.concat(F.lit("group "), "n_regionkey").alias("alias"), code))


def matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    priority, segment = F.col("o_orderpriority"), F.col("c_mktsegment")
    undated = (priority == "4-NOT SPECIFIED") & (F.col("o_orderkey") % 10 == 0)
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("target_name"),
        F.when(priority != "1-URGENT", segment).alias("acquirer_name"),
        F.when(segment != "HOUSEHOLD", F.concat(F.lit("N"), "c_nationkey")).alias("industry_code"),
        (segment != "HOUSEHOLD").alias("is_inferred_industry"),
        F.when(~undated, F.col("o_orderdate").cast("date")).alias("signing_date"),
        F.when(priority != "5-LOW", F.col("o_totalprice")).alias("deal_value"),
        F.col("o_orderstatus").alias("source_title"),
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 4, "0").alias("sic_code"),
        F.lit("orders").alias("corpus"),
        F.col("o_orderdate").alias("updated_at"),
    )


def deal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    quantity = F.col("l_quantity")
    position = (
        F.when(F.col("l_returnflag") == "N", "None")
        .when(F.col("l_returnflag") == "A", F.concat(quantity.cast("int").cast("string"), F.lit(" business days")))
        .when(F.col("l_linestatus") == "O", "Greater than 5 business days")
        .otherwise("All Cash")
    )
    start = F.when(F.col("l_partkey") % 25 != 0, (F.col("l_partkey") % 200).cast("int"))
    return (
        # The row without an earlier one. A rank would also be cut before the shuffle, by one more sort; keys repeat too seldom for that.
        line.withColumn("earlier", F.lag(F.lit(1)).over(first))
        .where("earlier IS NULL")
        .select(
            F.col("l_orderkey").alias("matter_id"),
            F.concat(F.lit("DP"), "l_linenumber").alias("deal_point_name"),
            position.alias("position"),
            F.when(F.col("l_returnflag") == "A", quantity.cast("double")).alias("numeric_value"),
            start.alias("span_start"),
            (start + 40).alias("span_end"),
            ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("is_inferred"),
            F.col("l_shipdate").alias("updated_at"),
        )
    )


VIEW_SQL = {
    "concepts": """
SELECT concat('R', r_regionkey) AS code, r_name AS label, CAST(NULL AS STRING) AS parent_code, 1 AS level,
       concat('R', r_regionkey) AS level_1_code, CAST(NULL AS STRING) AS level_2_code, CAST(NULL AS STRING) AS level_3_code
FROM region
UNION ALL
SELECT concat('N', n_nationkey), n_name, concat('R', n_regionkey), 2,
       concat('R', n_regionkey), concat('N', n_nationkey), CAST(NULL AS STRING)
FROM nation
UNION ALL
SELECT concat('S', s_suppkey), s_name, concat('N', s_nationkey), 3,
       concat('R', n_regionkey), concat('N', n_nationkey), concat('S', s_suppkey)
FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "aliases": """
SELECT concat('nation ', n_nationkey) AS alias, concat('N', n_nationkey) AS code FROM nation
UNION ALL
SELECT concat('group ', n_regionkey), concat('N', n_nationkey) FROM nation""",
    "matters": """
SELECT o_orderkey AS id, c_name AS target_name,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE c_mktsegment END AS acquirer_name,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE concat('N', c_nationkey) END AS industry_code,
       c_mktsegment <> 'HOUSEHOLD' AS is_inferred_industry,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS signing_date,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS deal_value,
       o_orderstatus AS source_title, lpad(CAST(o_custkey % 1000 AS STRING), 4, '0') AS sic_code, 'orders' AS corpus, o_orderdate AS updated_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "deal_points": """
SELECT matter_id, deal_point_name, position,
       CASE WHEN position LIKE '% business days' AND position NOT LIKE 'Greater%' THEN CAST(qty AS DOUBLE) END AS numeric_value,
       span_start, span_start + 40 AS span_end, is_inferred, updated_at
FROM (
  SELECT l_orderkey AS matter_id, concat('DP', l_linenumber) AS deal_point_name, l_quantity AS qty,
         CASE WHEN l_returnflag = 'N' THEN 'None'
              WHEN l_returnflag = 'A' THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' business days')
              WHEN l_linestatus = 'O' THEN 'Greater than 5 business days'
              ELSE 'All Cash' END AS position,
         CASE WHEN l_partkey % 25 = 0 THEN NULL ELSE CAST(l_partkey % 200 AS INT) END AS span_start,
         l_linestatus = 'F' AND l_returnflag = 'R' AS is_inferred, l_shipdate AS updated_at,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn
  FROM lineitem
) x WHERE rn = 1""",
}


def sql_with(*views: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named views as common table expressions."""
    heads = ",\n".join(f"{v} AS ({VIEW_SQL[v]}\n)" for v in views)
    return f"WITH {'RECURSIVE ' * recursive}{heads}\n{body}" if not body.lstrip().startswith(",") else f"WITH {'RECURSIVE ' * recursive}{heads}{body}"
