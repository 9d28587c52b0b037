"""The five stages on a small table, each against what a plain version keeps of its own input."""

import collections
import zlib

import corpus_pipeline
from termlake.llm.decontaminate import MIN_COVERAGE
from termlake.llm.token_files import END_ID, tokenizer_path

from .helpers import SF
from .test_decontaminate import brute as leaking
from .test_ngram_join import brute as grouped

assert MIN_COVERAGE <= 1


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()

    known = [(r.doc_id, r.text) for r in rows["language_id"]]
    assert 190 <= len(known) <= 200
    groups = grouped(known)
    kept = [(r.doc_id, r.text) for r in rows["ngram_join"]]
    assert sorted(d for d, _ in kept) == sorted({c for c, _, _ in groups.values()})
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaks = {d for d, _ in leaking(kept, items)}
    assert sorted(r.doc_id for r in rows["decontaminate"]) == sorted(d for d, _ in kept if d not in leaks)

    mixed = collections.Counter(r.doc_id for r in rows["mixing"])
    assert set(mixed) <= {r.doc_id for r in rows["decontaminate"]} and max(mixed.values()) <= 2
    texts = {r.doc_id: r.text for r in rows["mixing"]}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    start, want = 0, []
    for d in sorted(mixed):
        import numpy as np

        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, END_ID], "<u4")
        for _ in range(mixed[d]):
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in rows["token_files"]) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_whose_names_clash(spark):
    from pyspark.sql.functions import lit

    taken = ["_lang", "_score", "_letter", "_own", "_key", "_rep", "_bad_id", "_bad_th", "_size", "_draw", "_target", "_repeats", "_source", "_copy"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").withColumns({n: lit(-7) for n in taken}).repartition(2).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == -7 for r in rows for n in taken), name


def test_run_leaves_only_token_files(spark):
    import os

    from termlake.llm.token_files import files_of

    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    out = corpus_pipeline.run(spark, SF)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before}
    assert "token-files" in left and not any(x.startswith("pipeline") or x in ("sketches", "mix-sizes", "bench-windows", "near-classes") for x in left)
    assert files_of(out).startswith("file:") and base in files_of(out) and out.count() > 0
