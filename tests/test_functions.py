"""Text and numeric functions on hand-made inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from termlake.functions import numeric, text


def values(spark, inputs, build, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_clean_text(spark):
    got = values(spark, ["a  b\n c (Pages 12, 14–15) d", " x  (Page 3)", ""], text.clean_text)
    assert got == ["a b c d", "x", ""]


def test_numbers_in_answers(spark):
    inputs = ["4 business days", "within 12 months", "50%", "Greater than 5 days", "At least 2 days", "5", "", "none", "about 2.5 years", " 7days"]
    assert values(spark, inputs, text.numeric_from_text) == [4.0, 12.0, 50.0, None, None, None, None, None, 2.5, 7.0]


def test_names(spark):
    got = values(spark, ["Alpha Holdings, Incorporated", "Beta-Gamma Corp.", "The Company Company", " x "], text.normalize_name)
    assert got == ["ALPHA HOLDINGS INC", "BETA GAMMA CORP", "THE CO CO", "X"]
    assert values(spark, ["ALPHA GROUP", "ALPHA", "ALPHA GROUP INC"], text.without_suffix) == ["ALPHA", None, "ALPHA GROUP"]


def test_ids(spark):
    assert values(spark, ["a  b c "], text.content_key) == ["sha256_" + hashlib.sha256(b"a b c").hexdigest()]
    want = "cuad_" + hashlib.sha256(b"t\0k\x003\x009").hexdigest()[:24]
    assert values(spark, ["t"], lambda x: text.span_id(x, F.lit("k"), F.lit(3), F.lit(9))) == [want]
    assert values(spark, ["7", "12345678901"], lambda x: text.zero_pad(x, 4)) == ["0007", "12345678901"]


def test_redact_and_truncate(spark):
    got = values(spark, ["sk-proj-abcdefghijklmnop1234", "pg://user:pw@host", "bearer abcdefghijklmnopq", "sk-short"], text.redact)
    assert got == ["***", "pg://user:***@host", "bearer ***", "sk-short"]
    assert values(spark, ["abcdef", "abc"], lambda x: text.truncate(x, 3)) == ["abc…[+3 chars]", "abc"]


def test_tokens_keywords_and_dates(spark):
    assert values(spark, ["Café No. 12"], text.tokenize) == [["caf", "no", "12"]]
    assert values(spark, ["The Answer of a Go-Shop Period"], text.keywords) == [["shop", "period"]]
    got = values(spark, ["as of JANUARY 5, 2021", "February 30, 2020", "none"], text.header_date)
    assert [str(d) if d else None for d in got] == ["2021-01-05", None, None]


@pytest.mark.parametrize("allowed,hit,want", [(["No", "Yes"], True, "Yes"), (["No", "Yes"], False, "No"), (["A", "B"], True, "A"), ([], True, "")])
def test_keyword_class(spark, allowed, hit, want):
    options = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    found = values(spark, ["a fiduciary out" if hit else "nothing"], lambda x: text.keyword_class(F.array(F.lit("fiduciary")), x, options))
    assert found == [want]


@pytest.mark.parametrize("start,end,want", [(None, 3, (None, "no_span")), (0, 3, ("abc", None)), (1, 9, (None, "bad_span")), (2, 2, (None, "bad_span"))])
def test_slices(spark, start, end, want):
    n = lambda v: F.lit(v).cast("int")
    piece, reason = text.slice_text(F.lit("abcdé"), n(start), n(end))
    assert tuple(spark.range(1).select(piece, reason).first()) == want


def test_wilson(spark):
    low, high = numeric.wilson(F.lit(19), F.lit(20))
    a, b = spark.range(1).select(low, high).first()
    assert (round(a, 4), round(b, 4)) == (0.7639, 0.9911)
    assert tuple(spark.range(1).select(*numeric.wilson(F.lit(0), F.lit(0))).first()) == (0.0, 0.0)


@pytest.mark.parametrize("present,answered,want", [(0, 0, ("0 of 9", "count")), (3, 7, ("3 of 7", "count")), (1, 8, ("12%", "percentage")), (3, 8, ("38%", "percentage"))])
def test_render_at_the_threshold(spark, present, answered, want):
    assert tuple(spark.range(1).select(*numeric.render(F.lit(present), F.lit(answered), F.lit(9), 8)).first()) == want


def test_cosine(spark):
    pair = lambda a, b: spark.range(1).select(numeric.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert pair([1.0, 0.0], [2.0, 0.0]) == 1.0
    assert pair([0.0, 0.0], [1.0, 1.0]) == 0.0


def test_bands_and_skew(spark):
    assert values(spark, [None, 1e8, 2e8, 5e9, 1e10], numeric.size_band, "double") == ["unknown", "under_200m", "200m_to_1b", "1b_to_10b", "over_10b"]
    skewed = spark.createDataFrame([(float(x),) for x in [2, 2, 2, 2, 2, 3, 3, 4, 40]], "x double")
    assert tuple(round(v, 2) for v in skewed.agg(F.percentile("x", 0.5), F.avg("x")).first()) == (2.0, 6.67)
