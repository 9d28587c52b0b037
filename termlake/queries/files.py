"""Readers and writers of files, on files that are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_key
from ..operators import browse, retrieval, upsert
from ..sources import nested, readers
from ..sources import tables as t
from ..sources.shared import shared_path
from ..sources.tables import sql_with

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(*views, body=sql) if views else sql
        return f

    return wrap


FILES = 100  # that a task writes, about


def parts_for(files: int) -> int:
    """Tasks that write ``files`` files, so many that none writes for long."""
    return max(1, -(-files // FILES))


def one_row_files(rows, kind, path):
    """Write a file for each row, in place as its task ends: the folder is fresh, and moving files one by one at the job's end takes the driver long."""
    rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).format(kind).save(path)


@register("read_text_folder", "SELECT 'Supplier ' || s_suppkey || chr(10) || s_name || chr(10) AS text, CAST(1 AS BIGINT) AS files FROM supplier")
def read_text_folder(spark, sf_dir):
    """A file for each supplier."""
    path = shared_path(spark, "texts")
    s = t.load(spark, sf_dir, "supplier")
    texts = s.select(F.concat(F.lit("Supplier "), "s_suppkey", F.lit("\n"), "s_name").alias("value"))
    one_row_files(texts.repartition(parts_for(s.count())), "text", path)
    return readers.text_folder(spark, path, ordered=False).groupBy("text").agg(F.count_distinct("source_file").alias("files"))


def one_file(spark, lines, path, first, last=None):
    """Write ``lines`` (value) as one file between a first and a last line."""
    ends = spark.createDataFrame([(0, first)] + ([(2, last)] if last else []), "place int, value string")
    ends.unionByName(lines.select(F.lit(1).alias("place"), "value")).repartition(1).sortWithinPartitions("place").select("value").write.text(path)


ANNOTATED = "SELECT o_orderstatus AS contract_name, CASE WHEN o_orderkey % 3 = 0 THEN 'abridged' ELSE 'main' END AS data_type, o_orderpriority AS question, 'order \"' || o_orderkey || '\"' || chr(10) || 'as signed, by all' AS answer FROM orders"


def annotated(spark, sf_dir):
    path = shared_path(spark, "annotated")
    t.load(spark, sf_dir, "orders").createOrReplaceTempView("_orders_to_write")
    spark.sql(ANNOTATED.replace("FROM orders", "FROM _orders_to_write")).write.csv(path, header=True, quote='"', escape='"')
    return readers.annotated_csv(spark, path, drop_titles=("P",))


@register("read_annotated_csv", f"SELECT * FROM ({ANNOTATED}) WHERE data_type = 'main' AND contract_name <> 'P'")
def read_annotated_csv(spark, sf_dir):
    return annotated(spark, sf_dir)


@register("read_vocabulary", f"SELECT DISTINCT question FROM ({ANNOTATED}) WHERE data_type = 'main' AND contract_name <> 'P' ORDER BY question")
def read_vocabulary(spark, sf_dir):
    return readers.vocabulary_of(annotated(spark, sf_dir))


@register("read_nested_qa", """
SELECT 'cuad_' || left(sha256(c_name || chr(0) || 'Segment' || chr(0) || 9 || chr(0) || (9 + length(c_mktsegment))), 24) AS id, c_name AS title, 'Segment' AS clause_type, c_mktsegment AS text,
       9 AS char_start, CAST(9 + length(c_mktsegment) AS INT) AS char_end FROM customer""")
def read_nested_qa(spark, sf_dir):
    """Files of up to a thousand titles, each with an answered and an unanswered category."""
    path = shared_path(spark, "nested")
    qa = lambda kind, answers: F.struct(F.concat("c_name", F.lit(f"__{kind}")).alias("id"), answers.alias("answers"))
    answer = F.struct(F.col("c_mktsegment").alias("text"), F.lit(9).alias("answer_start"))
    qas = F.array(qa("Segment", F.array(answer)), qa("None", F.array_remove(F.array(answer), answer)))
    paragraph = F.struct(F.concat(F.lit("Segment: "), "c_mktsegment").alias("context"), qas.alias("qas"))
    customer = t.load(spark, sf_dir, "customer")
    titled = customer.select(F.floor(F.col("c_custkey") / 1000).alias("file"), F.struct(F.col("c_name").alias("title"), F.array(paragraph).alias("paragraphs")).alias("d"))
    whole = titled.repartition(parts_for(customer.count() // 1000), "file").groupBy("file").agg(F.collect_list("d").alias("data"))
    one_row_files(whole.select(F.lit("1").alias("version"), "data"), "json", path)
    return readers.nested_qa(spark, path)


@register("read_nested_split", """
SELECT 'cuad_' || left(sha256(c_name || chr(0) || 'Segment' || chr(0) || 9 || chr(0) || (9 + length(c_mktsegment))), 24) AS id, c_name AS title, 'Segment' AS clause_type, c_mktsegment AS text,
       9 AS char_start, CAST(9 + length(c_mktsegment) AS INT) AS char_end FROM customer""")
def read_nested_split(spark, sf_dir):
    """All customers in one file, read in ranges of 64 KB."""
    path = shared_path(spark, "nested-one")
    answer = F.array(F.struct(F.col("c_mktsegment").alias("text"), F.lit(9).alias("answer_start")))
    qas = F.array(F.struct(F.concat("c_name", F.lit("__Segment")).alias("id"), answer.alias("answers")))
    record = F.to_json(F.struct(F.col("c_name").alias("title"), F.array(F.struct(F.concat(F.lit("Segment: "), "c_mktsegment").alias("context"), qas.alias("qas"))).alias("paragraphs")))
    lines = t.load(spark, sf_dir, "customer").select(F.concat(F.lit(", "), record).alias("value"))
    one_file(spark, lines, path, '{"version": "1", "data": [{"title": "first", "paragraphs": []}', "]}")
    return nested.nested_qa_split(spark, path, 1 << 16)


@register("read_ontology", """
SELECT c.code, c.label, CASE WHEN c.level > 1 THEN 'level ' || c.level END AS definition, coalesce(c.parent_code, '') AS parents, coalesce(a.aliases, '') AS aliases
FROM concepts c LEFT JOIN (SELECT code, string_agg(alias, '|' ORDER BY alias) AS aliases FROM aliases GROUP BY code) a ON a.code = c.code""", "concepts", "aliases")
def read_ontology(spark, sf_dir):
    """Classes as XML, one that has no label among them; an alias equal to its label is none."""
    path = shared_path(spark, "ontology")
    c = t.concepts(spark, sf_dir)
    names = t.aliases(spark, sf_dir).groupBy("code").agg(F.collect_list("alias").alias("names"))
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))).otherwise("")
    parent = F.when(F.col("parent_code").isNotNull(), F.concat(F.lit('<rdfs:subClassOf rdf:resource="http://x/'), "parent_code", F.lit('"/>'))).otherwise("")
    alts = F.array_join(F.transform(F.array_append(F.coalesce("names", F.array().cast("array<string>")), F.col("label")), lambda a: tag("skos:altLabel", a)), "")
    body = F.concat(tag("rdfs:label", F.col("label")), parent, alts, tag("skos:definition", F.when(F.col("level") > 1, F.concat(F.lit("level "), "level"))))
    lines = c.join(names, "code", "left").select(F.concat(F.lit('<owl:Class rdf:about="http://x/'), "code", F.lit('">'), body, F.lit("</owl:Class>")).alias("value"))
    unlabelled = c.where("level = 1").select(F.concat(F.lit('<owl:Class rdf:about="http://x/none'), "code", F.lit('"><skos:altLabel>x</skos:altLabel></owl:Class>')).alias("value"))
    one_file(spark, lines.unionByName(unlabelled), path, "<rdf:RDF>", "</rdf:RDF>")
    found = readers.ontology_classes(spark, path)
    return found.select("code", "label", "definition", F.array_join("parents", "|").alias("parents"), F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


@register("read_name_index", r"SELECT trim(regexp_replace(regexp_replace(upper(c_name), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def read_name_index(spark, sf_dir):
    path = shared_path(spark, "names")
    t.load(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(":"), "c_custkey", F.lit(":")).alias("value")).write.text(path)
    return readers.name_index(spark, path)


@register("read_crosswalk", "SELECT lpad(CAST(p_size AS VARCHAR), 4, '0') AS sic, p_brand AS code, count(*) AS n FROM part GROUP BY 1, 2")
def read_crosswalk(spark, sf_dir):
    """Lines with a leading # are comments, and leading zeros stay."""
    path = shared_path(spark, "crosswalk")
    part = t.load(spark, sf_dir, "part")
    rows = part.select(F.concat_ws(",", F.lpad(F.col("p_size").cast("string"), 4, "0"), F.concat(F.lit("  "), "p_brand")).alias("value"))
    notes = part.where("p_partkey % 10 = 0").select(F.concat(F.lit("# "), "p_name").alias("value"))
    one_file(spark, rows.unionByName(notes), path, "sic,code")
    return readers.crosswalk(spark, path).groupBy("sic", "code").agg(F.count("*").alias("n"))


@register("read_log_lines", "SELECT event_id, event_type AS level, props FROM events")
def read_log_lines(spark, sf_dir):
    """Blank and broken lines stand between the events."""
    path = shared_path(spark, "log")
    e = t.load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"), "props")
    lines = e.select("event_id", F.to_json(F.struct("event_id", "level", "props")).alias("value"))
    broken = lines.where("event_id % 7 = 0").select(F.explode(F.array(F.lit(""), F.lit("not json"), F.left("value", F.lit(9)))).alias("value"))
    lines.select("value").unionByName(broken).write.text(path)
    return readers.log_lines(spark, path).select("event_id", "level", "props")


@register("vector_archives", """
SELECT 'sha256_' || sha256('text ' || vec_id) AS content_key, round((CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END) * CAST(embedding[1] AS DOUBLE), 6) AS first, round((CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END) * CAST(embedding[64] AS DOUBLE), 6) AS last
FROM embeddings""")
def vector_archives(spark, sf_dir):
    """Two saved archives with a third of the keys in both, merged: the earlier one's vectors, which are turned round, win."""
    base = shared_path(spark, "archives")
    keyed = t.load(spark, sf_dir, "embeddings").select("vec_id", content_key(F.concat(F.lit("text "), "vec_id")).alias("content_key"), "embedding")
    turned = keyed.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    for name, rows in (("earlier", turned), ("later", keyed)):
        retrieval.save_vectors(rows, f"{base}/{name}")
    merged = retrieval.merge_archives([readers.vectors(spark, f"{base}/{name}") for name in ("earlier", "later")])
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    return merged.select("content_key", at(1).alias("first"), at(64).alias("last"))


@register("append_decisions", "SELECT o_orderstatus AS decision, count(*) AS n, count(DISTINCT o_custkey) AS deciders FROM orders GROUP BY 1")
def append_decisions(spark, sf_dir):
    """Decisions that come in three batches to one table."""
    path = shared_path(spark, "decisions")
    o = t.load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("decision"), "o_custkey", "o_orderkey")
    for k in range(3):
        upsert.append(o.where(F.col("o_orderkey") % 3 == k), path)
    return spark.read.parquet(path).groupBy("decision").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("deciders"))


@register("export_csv", """
SELECT CAST(id AS VARCHAR) AS id, CAST(deal_value AS VARCHAR) AS deal_value, (SELECT count(*) > 700 FROM matters) AS cut FROM (SELECT id, CAST(deal_value AS BIGINT) AS deal_value FROM (SELECT id, floor(deal_value) AS deal_value FROM matters) ORDER BY deal_value DESC NULLS FIRST, id LIMIT 700)""", "matters")
def export_csv(spark, sf_dir):
    """The first rows of a sorted view as CSV, and whether rows were left out."""
    path = shared_path(spark, "export")
    rows = t.matters(spark, sf_dir).select("id", F.floor("deal_value").alias("deal_value"))
    cut = browse.export_csv(rows, path, "id", "deal_value", "desc", 700)
    return spark.read.csv(path, header=True).select("id", "deal_value", F.lit(cut).alias("cut"))


@register("file_digests", "SELECT sha256(n_name || chr(10) || coalesce(names, '')) AS sha256, length(n_name || chr(10) || coalesce(names, '')) AS length FROM nation LEFT JOIN (SELECT s_nationkey, string_agg(s_name || chr(10), '' ORDER BY s_name) AS names FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def file_digests(spark, sf_dir):
    """A file for each nation, with its suppliers in order."""
    path = shared_path(spark, "digests")
    nation, supplier = t.load(spark, sf_dir, "nation"), t.load(spark, sf_dir, "supplier")
    lines = supplier.select(F.col("s_nationkey").alias("file"), F.lit(1).alias("place"), F.col("s_name").alias("value"))
    heads = nation.select(F.col("n_nationkey").alias("file"), F.lit(0).alias("place"), F.col("n_name").alias("value"))
    heads.unionByName(lines).repartition("file").sortWithinPartitions("file", "place", "value").select("file", "value").write.partitionBy("file").text(path)
    return readers.file_digests(spark, f"{path}/file=*/*.txt").select("sha256", "length")
