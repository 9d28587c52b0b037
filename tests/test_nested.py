"""A nested file in byte ranges of any size gives what reading it whole gives."""

import json
import random

import pytest

from termlake.sources import nested, readers

HARD = ['{"title": "no record"}', 'ends in {', '"paragraphs": [', "\\", '\\"', "é漢😀", 'a\n{ "title"\t: 1', "", "}]}", '{\\"title\\":']


def sample(n, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        context = " ".join(rng.choices(HARD, k=rng.randrange(1, 9)))
        qas = [{"id": f"{rng.choice(HARD)}__K{k}", "question": rng.choice(HARD), "answers": [{"text": rng.choice(HARD), "answer_start": k}] * rng.randrange(3), "is_impossible": False} for k in range(rng.randrange(4))]
        record = {"title": f"t{i} " + rng.choice(HARD), "paragraphs": [{"context": context, "qas": qas}] * rng.randrange(1, 3)}
        data.append(record if rng.random() < 0.7 else dict(reversed(record.items())))
    return {"version": "x", "data": data}


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}, {"indent": "\t", "separators": (" ,", "  :  ")}])
@pytest.mark.parametrize("split", [7, 300, 10**6])
def test_records_of_all_ranges(tmp_path, monkeypatch, form, split):
    doc = sample(40)
    path = tmp_path / "f.json"
    path.write_text(json.dumps(doc, **form), encoding="utf-8")
    size = path.stat().st_size
    for block in (50, 1 << 20):
        monkeypatch.setattr(nested, "BLOCK_BYTES", block)
        found = [r for a in range(0, size, split) for r in nested.records(str(path), a, min(a + split, size))]
        assert found == doc["data"]
        if split == 7:
            break


def test_equals_the_reader_of_whole_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.json").write_text(json.dumps(sample(60, k)), encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    rows = nested.nested_qa_split(spark, str(tmp_path), 5000)
    assert rows.rdd.getNumPartitions() > 6
    want = readers.nested_qa(spark, str(tmp_path))
    assert rows.columns == want.columns and sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": "1", "data": []}')
    (tmp_path / "b.json").write_text("")
    assert nested.nested_qa_split(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        nested.nested_qa_split(spark, str(tmp_path / "missing")).count()
