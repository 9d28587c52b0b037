import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from termlake.llm import token_files
from termlake.llm.token_files import END_ID, batch_encoder, encoder, files_of, op6_token_files, pack_ranks, plain_byte_level, read_files, token_index, tokenizer_path, unpack_ranks, write_files

from .helpers import SF, docs


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


HARD = ["", " ", "  ", "a  b", "a\n b", " a", "a ", "a \n b", "x\n\n\ny", "it's we'll l'eau 'tis", "a  b  c", "x\u0085 y", "²3 ª º", "日本 語です。", "<|endoftext|> a", "hello <|endoftext|> world", "a<|endoftext|>", "a\t b  \n  c", "12 345,6 \n", "é É ß ſ", "\x1c \x1d a", "(word).\n[next]{one}--two_three", "a***b \n*c d\n\n*e x_'s _it's ('a') a\n b\n(c", "é.É!ß?\nÀ,"]


def test_units_equal_whole_texts(spark, plain):
    encode, dtype = encoder(tokenizer_path())
    texts = HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts:
        assert np.frombuffer(encode(text), dtype).tolist() == plain(text), text[:80]


def test_units_equal_whole_texts_when_dictionaries_turn_over(plain, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_CACHED", 50)
    encode, dtype = token_files._encoder(tokenizer_path(), as_text=False)
    rng = random.Random(5)
    pieces = [" ", " ", "\n", "\t", "a", "the", "é", "'", "'s", ",", ".", "(", "-", "_", "1", "23", "日", "ª", "\u0301", "\x85", "\u2003", "\x1c", "<|endoftext|>", "İ", "²"]
    for _ in range(5000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert np.frombuffer(encode(text), dtype).tolist() == plain(text), text


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = pack_ranks(x)
        assert len(control) == (n + 3) // 4
        assert unpack_ranks(control, data, n).tolist() == x.tolist()


def expected(texts, plain):
    out, start = [], 0
    for doc_id, text in texts:
        ids = np.array([*plain(text), END_ID], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_encoding(spark, plain):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in op6_token_files(spark, SF).collect()) == expected(texts, plain)


def test_edge_rows(spark, plain, tmp_path):
    rows = [(5, None), (2, ""), (9, "word " * 60_000), (3, "same"), (3, "same"), *((100 + i, t) for i, t in enumerate(HARD))]
    path = write_files(docs(spark, rows), str(tmp_path / "files"))
    got = read_files(spark, path).collect()
    want = expected(sorted(rows, key=lambda r: (r[0], r[1] or "")), plain)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)


def test_empty_table(spark, tmp_path):
    path = write_files(docs(spark, [(1, "a")]).where("false"), str(tmp_path / "files"))
    assert read_files(spark, path).count() == 0


def test_control_strings_as_text(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    encode, dtype = encoder(tokenizer_path(), as_text=True)
    for text in HARD:
        assert np.frombuffer(encode(text), dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def large_vocabulary(path):
    """The byte-level file with 20,000 more ids: two-letter words as added tokens of a vocabulary beyond 16 bits."""
    spec = json.load(open(tokenizer_path()))
    spec["added_tokens"] += [{**spec["added_tokens"][0], "id": 50257 + i, "content": f"<tok{i}>", "special": False} for i in range(20_000)]
    out = str(path / "large.json")
    json.dump(spec, open(out, "w"))
    return out


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "large"])
def test_other_tokenizer_files(spark, tmp_path, file):
    name = large_vocabulary(tmp_path) if file == "large" else tokenizer_path(file)
    tokenizer = Tokenizer.from_file(name)
    assert plain_byte_level(json.loads(tokenizer.to_str())) == (file == "large")
    rows = [*enumerate(HARD), (900, "Words of <tok7> and <tok19999> stay"), (901, None)]
    index = token_index(docs(spark, rows), str(tmp_path / "files"), name)
    want = expected(rows, lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids)
    assert sorted(tuple(r) for r in index.collect()) == want
    assert files_of(index).endswith(str(tmp_path / "files"))
    assert read_files(spark, files_of(index)).count() == len(rows)


def test_repeated_rows_are_spread_over_ranges(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    path = write_files(docs(spark, [(7, f"hot text {i % 2}") for i in range(4000)]).repartition(4), str(tmp_path / "files"))
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").count().collect()
    assert len(parts) > 1
    assert sorted(r.start for r in read_files(spark, path).collect())[0] == 0


def batch_ids(texts, kind=pa.string()):
    encode, dtype = batch_encoder(tokenizer_path())
    return [np.frombuffer(x, dtype).tolist() for x in encode(pa.array(texts, kind))]


@pytest.mark.parametrize("chunk", [1, 64, 1 << 22])
def test_batches_equal_whole_texts(spark, plain, monkeypatch, chunk):
    monkeypatch.setattr(token_files, "CHUNK_BYTES", chunk)
    texts = [None, "", *HARD, None, *HARD[::-1], *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()), ""]
    assert batch_ids(texts) == [plain(t) for t in texts]
    assert batch_ids(["", None]) == [[], []] and batch_ids([]) == []
    encode, dtype = batch_encoder(tokenizer_path())
    assert [np.frombuffer(x, dtype).tolist() for x in encode(pa.array(texts, pa.large_string()).slice(3, 9))] == [plain(t) for t in texts[3:12]]


def test_batches_equal_whole_texts_when_dictionaries_turn_over(plain, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_CACHED", 50)
    encode, dtype = token_files._batch_encoder(tokenizer_path())
    rng = random.Random(6)
    pieces = [*"  \n\n\t\r'.,(-_|1日ªéжÀ×÷ɏɐǀ²½あ“–\u0301\x85\xa0\u2003\u3000\u180e\u200b\x1c\x00\x7f😀", "a", "the", "'s", "'ll", "23"]
    for part in range(20):
        some = pieces + ["<|endoftext|>"] * (part % 2)
        texts = ["".join(rng.choices(some, k=rng.choice((0, 1, 2, 3, 6, 14)))) for _ in range(250)]
        for text, ids in zip(texts, encode(pa.array(texts))):
            assert np.frombuffer(ids, dtype).tolist() == plain(text), text


def test_added_token_across_two_texts_is_none(plain):
    texts = ["x <|endof", "text|> y", "<|endoftext|>"]
    assert batch_ids(texts) == [plain(t) for t in texts]


def test_words_are_encoded_once_whatever_marks_and_lines_join_them(plain, monkeypatch):
    asked, fresh = [], token_files.PieceIds.fresh
    monkeypatch.setattr(token_files.PieceIds, "fresh", lambda self, piece: (asked.append(piece), fresh(self, piece))[1])
    words = ["amber", "birch", "cedar", "dune", "été", "fjord", "grove", "hazel"]
    texts = [f"the {a},{b}.\n{c} {a}({b})\n{c}" for a in words for b in words for c in words]
    encode, dtype = token_files._batch_encoder(tokenizer_path())
    assert [np.frombuffer(x, dtype).tolist() for x in encode(pa.array(texts))] == [plain(t) for t in texts]
    assert len(asked) <= 2 * len(words) + 8
