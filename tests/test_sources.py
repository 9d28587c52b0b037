"""Readers of the source formats, on small files."""

import json

from termlake.sources import readers, tables

ONTOLOGY = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:skos="http://www.w3.org/2004/02/skos/core#">
<owl:Class rdf:about="http://x/A"><rdfs:label>Area</rdfs:label><skos:altLabel>Area</skos:altLabel><skos:altLabel>Zone</skos:altLabel></owl:Class>
<owl:Class rdf:about="http://x/B"><rdfs:label>Branch</rdfs:label><rdfs:subClassOf rdf:resource="http://x/Z"/><rdfs:subClassOf rdf:resource="http://x/A"/><skos:definition>a part</skos:definition></owl:Class>
<owl:Class rdf:about="http://x/C"><rdfs:subClassOf rdf:resource="http://x/A"/></owl:Class>
</rdf:RDF>
"""


def test_ontology(spark, tmp_path):
    (tmp_path / "o.owl").write_text(ONTOLOGY)
    got = {r.code: (r.label, r.definition, list(r.parents), list(r.aliases)) for r in readers.ontology_classes(spark, str(tmp_path / "o.owl")).collect()}
    assert got == {"A": ("Area", None, [], ["Zone"]), "B": ("Branch", "a part", ["A", "Z"], [])}


def test_nested_qa(spark, tmp_path):
    context = "The parties agree. The term is five years."
    qas = [{"id": "t__Term", "question": "q", "answers": [{"text": "five years", "answer_start": 31}], "is_impossible": False}, {"id": "t__None", "question": "q", "answers": [], "is_impossible": True}]
    (tmp_path / "q.json").write_text(json.dumps({"version": "1", "data": [{"title": "t", "paragraphs": [{"context": context, "qas": qas}]}]}, indent=1))
    rows = readers.nested_qa(spark, str(tmp_path / "q.json")).collect()
    assert [(r.clause_type, context[r.char_start : r.char_end], len(r.id)) for r in rows] == [("Term", "five years", 29)]


def test_small_files(spark, tmp_path):
    texts = tmp_path / "texts"
    texts.mkdir()
    for n in (2, 10, 1):
        (texts / f"contract_{n}.txt").write_text(f"﻿text  {n}\nend")
    assert [r.source_file for r in readers.text_folder(spark, str(texts)).collect()] == ["contract_1.txt", "contract_2.txt", "contract_10.txt"]
    assert readers.titles(readers.text_folder(spark, str(texts))).first().title == "text 1 end"
    (tmp_path / "idx.txt").write_bytes("ALPHA, INC.:12:\nAlpha Inc:99:\nB\xe9TA CO:0000000034:\n:1:\n".encode("latin-1"))
    assert {(r.name, r.cik) for r in readers.name_index(spark, str(tmp_path / "idx.txt")).collect()} == {("ALPHA INC", "0000000012"), ("B TA CO", "0000000034")}
    (tmp_path / "x.csv").write_text("# note\nsic,code\n01,A\n0100,B\n")
    assert {tuple(r) for r in readers.crosswalk(spark, str(tmp_path / "x.csv")).collect()} == {("01", "A"), ("0100", "B")}
    (tmp_path / "l.jsonl").write_text('{"level": "info", "event": "a"}\n\nnot json\n{"level": "error", "event": "b"}\n')
    assert readers.log_lines(spark, str(tmp_path / "l.jsonl")).count() == 2
    (tmp_path / "a.csv").write_text('contract_name,data_type,question,answer\nc1,main,q1,"a ""quoted""\nline"\nc1,abridged,q2,x\n<RARE>,main,q3,y\n')
    rows = readers.annotated_csv(spark, str(tmp_path / "a.csv"), drop_titles=("<RARE>",))
    assert [(r.question, r.answer) for r in rows.collect()] == [("q1", 'a "quoted"\nline')]
    assert readers.vocabulary_of(rows).count() == 1
    assert len(readers.file_digests(spark, str(tmp_path / "x.csv")).first().sha256) == 64


def test_views_agree_with_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("region", "nation", "supplier", "orders", "customer", "lineitem"):
        tables.load(spark, sf, name).createOrReplaceTempView(name)
    for view in ("concepts", "aliases", "matters", "deal_points"):
        mine, stated = getattr(tables, view)(spark, sf), spark.sql(tables.VIEW_SQL[view])
        assert mine.columns == stated.columns
        assert mine.exceptAll(stated).count() == 0 and stated.exceptAll(mine).count() == 0
