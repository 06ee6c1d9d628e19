"""Scalar expressions against hand-written values."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as X


def one(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "x string").select(*exprs).first()


@pytest.mark.parametrize(
    ("raw", "want"),
    [(" a  b ", "a b"), ("a　b\tc\nd", "a b c d"), ("x··•y", "x y"), ("", ""), (None, None), (" ", ""), ("a\x1cb\x85c", "a b c")],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize(F.col("x")))[0] == want


@pytest.mark.parametrize(("raw", "want"), [("中文", "zh"), ("abc", "en"), ("中a", "mixed_zh"), ("中ab", "mixed_en"), ("12-3", "mixed_zh"), ("", "mixed_zh")])
def test_language_class(spark, raw, want):
    assert one(spark, raw, X.language_class(F.col("x")))[0] == want


@pytest.mark.parametrize(("raw", "want"), [("A b. C d! E", ["A b.", "C d!", "E"]), ("甲。乙。", ["甲。乙。"]), ("甲。 乙; c", ["甲。", "乙;", "c"]), ("", []), ("  ", [])])
def test_split_sentences(spark, raw, want):
    assert one(spark, raw, X.split_sentences(F.col("x")))[0] == want


@pytest.mark.parametrize(("raw", "want"), [("中文x", ["中文", "文x"]), ("中", []), ("Ab c-1", ["ab", "c", "1"]), ("", []), ("中  文", ["中 ", " 文"])])
def test_query_terms(spark, raw, want):
    assert one(spark, raw, X.query_terms(F.col("x")))[0] == want


@pytest.mark.parametrize(
    ("raw", "kind"),
    [("第一部分 总则", "part_zh"), ("Part IV x", "part_en"), ("part contains", "part_en"), ("第十二章 x", "chapter_zh"), ("附件 3", "appendix_zh"), ("Appendix4", "appendix_en"), ("body", None)],
)
def test_heading_kind(spark, raw, kind):
    assert one(spark, raw, X.heading_kind(F.col("x")))[0] == kind


def test_suffix_noise_and_markers(spark):
    assert one(spark, "第一章 总则.....  12", X.clean_heading_suffix(F.col("x")))[0] == "第一章 总则"
    assert one(spark, "电压 25", X.clean_heading_suffix(F.col("x")))[0] == "电压"
    assert [one(spark, s, X.is_noise(F.col("x")))[0] for s in ("", "--I", "目录", "abc")] == [True, True, True, False]
    row = one(spark, "严禁带电作业，应当检查", X.clause_risk(F.col("x")), X.content_type(F.col("x")), X.evidence_priority(F.col("x")))
    assert tuple(row) == ("high", "restriction", 3 + 2 + 1 + 1)
    assert tuple(one(spark, "x", X.clause_risk(F.col("x")), X.content_type(F.col("x")), X.evidence_priority(F.col("x")))) == ("low", "description", 0)


@pytest.mark.parametrize(
    ("raw", "short", "full"),
    [("Overhead Line (OHL) x", "OHL", "Overhead Line"), ("surge arrester", "SA", "surge arrester"), ("fuse", "", "fuse"), ("", "", ""), ("a (b) c", "ABC", "a (b) c")],
)
def test_abbreviation(spark, raw, short, full):
    assert tuple(one(spark, raw, X.abbreviation(F.col("x")), X.full_form(F.col("x")))) == (short, full)


def test_names_and_keywords(spark):
    row = one(spark, "牵引 ab 供电 ab c", X.keywords(F.col("x"), F.lit("zz 牵引")), X.aliases(F.lit("a"), F.lit(None).cast("string"), F.lit("A"), F.lit("a ")))
    assert row[0] == ["牵引", "ab", "供电", "zz"] and row[1] == ["a", "A"]


def test_term_pairs(spark):
    got = one(spark, "接触线 contact wire 吊弦 dropper", X.term_pairs(F.col("x")))[0]
    assert [tuple(p) for p in got] == [("接触线", "contact wire"), ("吊弦", "dropper")]
    bad = [("接", "wire"), ("接触线", "the"), ("索引词", "index"), ("接触线", "wire (x"), ("接触线", "a@b")]
    df = spark.createDataFrame([*bad, ("接触线", "contact wire (CW)")], "z string, e string")
    assert [r[0] for r in df.select(X.low_quality_pair(F.col("z"), F.col("e"))).collect()] == [True] * 5 + [False]


def test_questions(spark):
    kinds = {"术语消融实验": "paper", "双语回答": "bilingual", "“母线”英文怎么说？": "term", "跳闸故障原因": "fault", "检修流程": "procedure", "多久检查一次": "regulation"}
    for text, kind in kinds.items():
        assert one(spark, text, X.query_class(F.col("x")))[0] == kind
    assert tuple(one(spark, "带电检修", X.query_risk(F.col("x")), X.risk_markers(F.col("x")))) == ("high", ["带电", "检修"])
    assert [one(spark, s, X.query_risk(F.col("x")))[0] for s in ("检修操作", "检修", "x", "")] == ["medium", "low", "none", "none"]
    assert one(spark, "母线和fuse or clamp对应", X.term_candidates(F.col("x")))[0] == ["母线", "fuse", "clamp"]
    assert one(spark, "A or and B", X.term_candidates(F.col("x")))[0] == ["a or", "b"]
    assert one(spark, "“母线”英文怎么说？", X.translation_candidate(F.col("x")))[0] == "“母线”"
    assert one(spark, "如何检查吊弦 abc", X.content_terms(F.col("x")))[0] == ["检查吊弦", "abc"]
    assert one(spark, "aaa", X.occurrences(F.col("x"), F.lit("aa")))[0] == 1
