"""Operators on hand-made tables: selections, gates, facets, hierarchies, retrieval, spans, mutation, browsing."""

import pytest
from pyspark.sql import functions as F

from termlake.operators import browse, coverage, evals, facets, gates, headers, hierarchy, resolve, retrieval, rollup, upsert
from termlake.operators.spans import locate_spans, locator
from termlake.plans.compile import InvalidSelection, compile_selection, governed
from termlake.plans.model import MEASURES, Cubes, Selection


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def cubes(spark):
    facts = spark.createDataFrame(
        [(1, "DP1", "4 days", 4.0, 3, False), (1, "DP2", "None", None, None, True), (2, "DP1", "All Cash", None, 5, False), (9, "DP1", "6 days", 6.0, 1, False)],
        "matter_id long, deal_point_name string, position string, numeric_value double, span_start int, is_inferred boolean",
    ).withColumn("span_end", F.col("span_start") + 1).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    matters = spark.createDataFrame(
        [(1, "a", None, "N1", True, "2020-01-05", 50_000.0), (2, "b", "x", None, False, None, None), (3, "c", "x", "N1", True, "2020-02-05", 300_000.0)],
        "id long, target_name string, acquirer_name string, industry_code string, is_inferred_industry boolean, signing_date string, deal_value double",
    ).withColumn("signing_date", F.col("signing_date").cast("date"))
    matters = matters.withColumn("source_title", F.lit("t")).withColumn("sic_code", F.lit("1")).withColumn("corpus", F.lit("c")).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    concepts = spark.createDataFrame([("N1", "North", "R1", 2, "R1", "N1", None)], "code string, label string, parent_code string, level int, level_1_code string, level_2_code string, level_3_code string")
    return Cubes(facts, matters, concepts)


def test_counts_survive_fan_out(cubes):
    out = compile_selection(Selection(["matters.n", "deal_points.n"], ["concepts.label"]), cubes)
    assert rows(out) == [("North", 2, 2), (None, 1, 1)]
    alone = compile_selection(Selection(["deal_points.matters_total", "deal_points.n"]), cubes)
    assert rows(alone) == [(3, 4)]


def test_distinct_counts_are_exact(cubes):
    plan = compile_selection(Selection(["deal_points.count_distinct_matters"], ["deal_points.position"]), cubes)._jdf.queryExecution().toString()
    assert "approx" not in plan.lower()
    assert all(m.how != "approx" for m in MEASURES.values())


@pytest.mark.parametrize("bad", [
    {"measures": ["nope.n"]}, {"measures": ["deal_points.mean_numeric_value_do_not_use_for_market"]}, {"dimensions": ["deal_points.id"]},
    {"measures": ["matters.n"], "filters": [{"member": "matters.corpus", "operator": "like", "values": ["x"]}]}, {"measures": ["matters.n"], "limit": 0},
    {"measures": ["matters.n"], "order": {"matters.id": "asc"}}, {"time_dimensions": [{"dimension": "matters.corpus", "granularity": "day"}]},
])
def test_bad_selections_never_build_a_plan(bad):
    with pytest.raises(InvalidSelection):
        compile_selection(Selection(**bad), None)


def test_governed_groups(cubes):
    out = governed(Selection(["deal_points.median_numeric_value"], ["deal_points.deal_point_name"]), cubes, 3)
    assert rows(out) == [("DP1", 5.0)]


def test_gates(spark):
    assert gates.refusal(spark, [1, 2, 2, 3, 4]).first().refused
    assert not gates.refusal(spark, [1, 2, 3, 4, 5]).first().refused
    df = spark.createDataFrame([("a", 4), ("b", 5)], "k string, n long")
    assert rows(gates.suppress(df, "n")) == [("b", 5)]


def test_facets_exclude_themselves(spark):
    base = spark.createDataFrame([("x", "2020"), ("x", "2021"), ("y", "2020"), (None, "2020")], "industry string, year string")
    groups = {"industry": "industry", "year": "year"}
    got = {(r.facet, r.value): (r.n, r.selected, r.reason) for r in facets.facets(base, groups, {"industry": "x", "year": ""}).collect()}
    assert got["industry", "y"] == (1, False, None)  # its own filter doesn't hide it
    assert got["industry", "unclassified"] == (1, False, "no industry resolved")
    assert got["year", "2020"] == (1, False, None) and got["industry", "x"] == (2, True, None)
    both = facets.facets(base, groups, {"industry": "y", "year": "2021"})
    assert {(r.facet, r.value): r.n for r in both.collect()}["industry", "y"] == 0  # zeros stay


def test_coverage_is_dense(spark):
    base = spark.createDataFrame([("x", "a")] * 5 + [("y", "b")] * 4, "l string, c string")
    grid = coverage.coverage_grid(base, "l", "c", 5)
    got = {(r.label, r.column): (r.n, r.reportable) for r in grid.collect()}
    assert got == {("x", "a"): (5, True), ("x", "b"): (0, False), ("y", "a"): (0, False), ("y", "b"): (4, False)}
    assert ("grand", "", 9, 3, 2) in rows(coverage.coverage_totals(grid))


def test_rollup_and_absences(cubes, spark):
    vocabulary = spark.createDataFrame([("DP1",), ("DP3",)], "deal_point_name string")
    chosen = spark.createDataFrame([(1,), (2,)], "matter_id long")
    got = {r.deal_point_name: r for r in rollup.deal_terms(cubes.deal_points, vocabulary, chosen, 2, 2).collect()}
    assert (got["DP1"].n, got["DP1"].median_value, got["DP1"].rendered) == (2, 4.0, "100%")
    assert (got["DP2"].rendered, got["DP3"].rendered, got["DP3"].reason) == ("0 of 1", "0 of 2", "not answered in this selection")


LABELS = [("a", "Root"), ("b", "Mid"), ("c", "Leaf"), ("d", "DEPRECATED old"), ("e", "Below"), ("x", "Loop"), ("y", "Loop too")]
EDGES = [("b", "a"), ("c", "b"), ("c", "e"), ("e", "d"), ("x", "y"), ("y", "x"), ("b", "d")]


def test_hierarchy(spark):
    labels = spark.createDataFrame(LABELS, "code string, label string")
    edges = spark.createDataFrame(EDGES, "code string, parent_code string")
    excluded = hierarchy.excluded_subtree(labels, edges, ("DEPRECATED",))
    assert rows(excluded) == [("b",), ("c",), ("d",), ("e",)]
    flat = {r.code: (r.level, r.parent_code, r.level_1_code) for r in hierarchy.flattened(labels, edges, excluded.where("code IN ('d', 'e')")).collect()}
    assert flat["c"] == (3, "b", "a") and flat["a"] == (1, None, "a") and flat["x"] == (2, "y", "y")
    down = hierarchy.descendants(edges, spark.createDataFrame([("a",)], "code string"))
    assert rows(down) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]


def test_roll_up_at_any_depth(spark):
    schema = "code string, parent_code string, level int, level_1_code string, level_2_code string, level_3_code string"
    chain = [("a", None, 1, "a", None, None), ("b", "a", 2, "a", "b", None), ("c", "b", 3, "a", "b", "c"), ("d", "c", 4, "a", "b", "c"), ("e", "d", 5, "a", "b", "c"), ("z", None, 1, "z", None, None)]
    entities = spark.createDataFrame([(i, c) for i, c in enumerate("abcdez")] + [(9, None)], "id int, industry_code string")
    ids = lambda rows, code: sorted(r.id for r in hierarchy.under(entities, spark.createDataFrame(rows, schema), code).collect())
    assert ids(chain, "b") == [1, 2, 3, 4] and ids(chain, "d") == [3, 4] and ids(chain, "z") == [5]
    assert ids(chain[:3], "a") == [0, 1, 2] and ids(chain[:3], "c") == [2]


def test_resolution(spark):
    prefixes = spark.createDataFrame([("28", "x"), ("283", "y"), ("0100", "z")], "prefix string, code string")
    codes = spark.createDataFrame([("2834",), ("2899",), ("100",), ("99",), (None,)], "sic string")
    assert [r.prefix_code for r in resolve.longest_prefix(codes, prefixes).orderBy("sic").collect()] == [None, "z", "y", "x", None]
    index = spark.createDataFrame([("ALPHA", "1"), ("BETA CORP", "2")], "name string, cik string")
    names = spark.createDataFrame([("Alpha, Inc.",), ("Beta Corporation",), ("Alpha Beta",)], "name string")
    assert {r.name: r.cik for r in resolve.resolve_names(names, index).collect()} == {"Alpha, Inc.": "1", "Beta Corporation": "2", "Alpha Beta": None}
    similar = spark.createDataFrame([("odd", "N1", 0.6), ("odd", "N2", 0.4), ("far", "N1", 0.5)], "raw string, code string, similarity double")
    asked = spark.createDataFrame([("north",), ("n-one",), ("odd",), ("far",)], "raw string")
    concepts = spark.createDataFrame([("N1", "North")], "code string, label string")
    aliases = spark.createDataFrame([("N-One", "N1")], "alias string, code string")
    assert rows(resolve.resolve_ladder(asked, concepts, aliases, similar)) == [("far", None, "refused"), ("n-one", "N1", "alias"), ("north", "N1", "exact"), ("odd", "N1", "embedding")]


@pytest.fixture(scope="module")
def ranked(spark):
    return spark.createDataFrame(
        [(1, "cash merger agreement", [1.0, 0.0]), (2, "stock merger deal", [0.0, 1.0]), (3, "lease of land", [0.6, 0.8])], "id long, text string, embedding array<double>"
    )


def test_hybrid_ranking(ranked):
    lexical = retrieval.bm25(ranked, "cash agreement")
    semantic = retrieval.cosine_scores(ranked, F.array(F.lit(0.0), F.lit(1.0)))
    order = lambda alpha: [r.id for r in retrieval.top_k(retrieval.hybrid(lexical, semantic, (alpha,)), 3).collect()]
    assert order(0.0)[0] == 1 and order(1.0)[0] == 2 and order(0.0) != order(1.0)
    assert {r.norm for r in retrieval.minmax(retrieval.bm25(ranked, "nowhere")).collect()} == {0.0}
    assert retrieval.bm25(ranked.where("false"), "cash").count() == 0


def test_archive_lookup(spark, ranked):
    keys = retrieval.to_embed([ranked, ranked]).withColumn("embedding", F.array(F.lit(1.0)))
    assert keys.count() == 3
    asked = spark.createDataFrame([(1, "cash  merger agreement"), (2, "unknown")], "id long, text string")
    assert rows(retrieval.embedded(asked, keys.select("content_key", "embedding")).select("id", "missing")) == [(1, False), (2, True)]


SOURCE = "Section 1.  The quick brown fox\njumps over the lazy dog. ---- page ---- Section 2. Pack my box with five dozen liquor jugs today."


def test_spans(spark):
    plain = locator(SOURCE)("The quick brown fox jumps over the lazy dog. (Page 3)")
    assert SOURCE[plain[0] : plain[1]] == "The quick brown fox\njumps over the lazy dog."
    both = locator(SOURCE)("The quick brown fox jumps<omitted>Pack my box with five dozen")
    assert SOURCE[both[0] : both[1]].startswith("The quick") and SOURCE[both[0] : both[1]].endswith("dozen")
    assert locator(SOURCE)("something that is not in the text at all") is None
    assert locator("")("something that is not in the text at all") is None
    excerpts = spark.createDataFrame([(1, 7, "The quick brown fox jumps over"), (2, 7, "absent from the source text"), (3, 8, "no such document at all here")], "id long, doc_id long, excerpt string")
    got = {r.id: (r.span_start, r.span_end) for r in locate_spans(excerpts, spark.createDataFrame([(7, SOURCE)], "doc_id long, text string")).collect()}
    assert got == {1: (12, 42), 2: (None, None), 3: (None, None)}


def test_headers(spark):
    data = [
        (1, "AGREEMENT by and among ALPHA PHARMACEUTICALS, INC., ALPHA REEF MERGER SUB, INC. and OMEGA SYSTEMS GROUP, INC. Dated as of JANUARY 5, 2021 TABLE OF CONTENTS"),
        (2, "AGREEMENT between BUYER CORPORATION and SELLER COMPANY dated March 31, 2020 ARTICLE I OTHER INC."),
        (3, "no parties here, signed February 30, 2020"),
    ]
    got = {r.id: (r.acquirer_name, r.target_name, str(r.signing_date)) for r in headers.parse_headers(spark.createDataFrame(data, "id long, text string")).collect()}
    assert got[1] == ("ALPHA PHARMACEUTICALS, INC.", "OMEGA SYSTEMS GROUP, INC.", "2021-01-05")
    assert got[2] == ("BUYER CORPORATION", "SELLER COMPANY", "2020-03-31")
    assert got[3] == (None, None, "None")


def test_upserts_move_the_stamp_only_for_changes(spark):
    schema = "id long, v string, updated_at timestamp"
    old = spark.sql("SELECT * FROM VALUES (1L, 'a', TIMESTAMP'2020-01-01'), (2L, NULL, TIMESTAMP'2020-01-01'), (3L, 'c', TIMESTAMP'2020-01-01') t(id, v, updated_at)")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id long, v string")
    stamp = F.lit("2030-01-01").cast("timestamp")
    got = {r.id: (r.v, r.updated_at.year, r.change) for r in upsert.guarded_upsert(old, new, ["id"], stamp).collect()}
    assert got == {1: ("a", 2020, "keep"), 2: ("b", 2030, "update"), 3: ("c", 2020, "keep"), 4: ("d", 2030, "insert")}
    again = upsert.guarded_upsert(old, old.select("id", "v"), ["id"], stamp)
    assert {r.change for r in again.collect()} == {"keep"}
    pruned = upsert.upsert_and_prune(old, new, ["id"], F.col("id") > 2, stamp)
    assert sorted(r.id for r in pruned.collect()) == [1, 2, 4]
    assert sorted(r.id for r in upsert.update_only(old, new, ["id"], stamp).collect()) == [1, 2, 3]
    more = spark.createDataFrame([], schema).unionByName(old)
    assert upsert.insert_ignore(more, old.union(old), ["id"]).count() == 3


def test_browsing(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "Abc"), (2, 5, "x_c"), (3, 7, None)], "id int, v int, s string")
    assert [r.id for r in browse.page(df, "id", "v").collect()] == [2, 3, 1]
    assert [r.id for r in browse.page(df, "id", "v", "desc").collect()] == [1, 3, 2]
    assert [r.id for r in browse.page(df, "id", limit=1, offset=1).collect()] == [2]
    assert [r.id for r in browse.contains(df, "s", "bC").collect()] == [1]
    with pytest.raises(browse.UnknownColumn):
        browse.contains(df, "s; DROP TABLE x", "a")
    with pytest.raises(ValueError):
        browse.page(df, "id", limit=501)
    assert {r.column: r.n_null for r in browse.profile(df).collect()} == {"id": 0, "v": 1, "s": 1}
    assert browse.export_csv(df, str(tmp_path / "out"), "id", most=2) is True
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    lines = spark.createDataFrame([(1, "info", "Alpha"), (2, "error", "alpha"), (3, "info", "Alpha")], "line_no int, level string, msg string")
    assert [(r.line_no, r.total_matched) for r in browse.log_search(lines, "info", "Alpha", 1, 1).collect()] == [(3, 2)]


def test_evaluation(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    prf = lambda e, x: tuple(spark.range(1).select(*evals.precision_recall(a(*e), a(*x))).first())
    assert prf([], []) == (1.0, 1.0) and prf(["a"], []) == (0.0, 0.0) and prf(["a", "b"], ["a"]) == (1.0, 0.5)
    assert spark.range(1).select(evals.same_set(a("a", "b"), a("b", "a", "a"))).first()[0]
    refused = spark.range(1).select(evals.refused_by_grader(a(), a("d"), F.lit(None)), evals.refused_by_harness(a(), F.lit(None)))
    assert tuple(refused.first()) == (False, True)
    many = spark.range(100).withColumnRenamed("id", "id")
    assert [r.id for r in evals.systematic_sample(many, "id", 30).orderBy("id").collect()][:3] == [0, 3, 6]
    assert evals.holdout_by_hash(many, "id").count() == 20
    queue = spark.createDataFrame([(1, "b", "x", "x"), (2, "a", "x", "y")], "id long, deal_point_name string, predicted string, baseline string")
    assert [r.id for r in evals.disagreement_queue(queue).collect()] == [2, 1]
