import pytest
from pyspark.sql import functions as F

from docmill.functions import dates, lines, norm
from docmill.operators import cleaner


def values(spark, column, items, schema="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {schema}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    given = ["2003-10-26", "20031026", "2003/9/4", "2003.10.04", "2003年1月2日", " 2013-04-11 ", "2013-04-11 00:00:00", "2003-02-30", "不详", "", None, "9999-12-31"]
    want = ["2003-10-26", "2003-10-26", "2003-09-04", "2003-10-04", "2003-01-02", "2013-04-11", "2013-04-11", None, None, None, None, "9999-12-31"]
    assert [None if x is None else str(x) for x in values(spark, dates.lenient_date, given)] == want


def test_years(spark):
    assert values(spark, dates.lenient_year, ["2018", "２０１８", "2018年度", "2018.0", "18", " 2015 ", "98", "x", "", None]) == [2018, 2018, 2018, 2018, 2018, 2015, 1998, None, None, None]


def test_codes(spark):
    got = values(spark, norm.standard_code, ["GB/T 19001-2016", "GB 3836.1-2021", "ＧＢ／Ｔ １９００１", "abc-12x", "a-b-2001", "", None])
    assert [(x["base"], x["version"]) for x in got] == [("GB/T19001", "2016"), ("GB3836.1", "2021"), ("GB/T19001", None), ("ABC12X", None), ("AB", "2001"), (None, None), (None, None)]
    assert values(spark, norm.stock_code, ["1", "000001.0", " 12 ", "1234567", "A1", None]) == ["000001", "000001", "000012", "1234567", "A1", None]
    assert values(spark, norm.report_year, ["2024", "2024年", "FY 2023 x", "17", None]) == [2024, None, 2023, 2017, None]
    assert values(spark, norm.full_year, ["98", "15", "2004", "123", None]) == [1998, 2015, 2004, 0, 0]


def test_text_helpers(spark):
    assert values(spark, norm.tolerant_bool, ["TRUE", " y", "1", "no", None]) == [True, True, True, False, False]
    assert values(spark, lambda c: norm.truncated(c, 3), ["abcd", "abc", None]) == ["abc...[truncated 1 chars]", "abc", None]
    assert values(spark, lambda c: norm.head_and_tail(c, 4, 2), ["abcdefgh", "abcde", "ab", None]) == ["abcd\n...[truncated 2 chars]...\ngh", "abcd", "ab", ""]
    assert values(spark, lambda c: norm.unit_text(c), ["Ａ  b\r\nc\t d ", None]) == ["A b\nc d", None]
    assert values(spark, norm.line_preview, ["a\r\nb"]) == ["a\\nb"]


def test_grounding(spark):
    df = spark.createDataFrame([("ISO 9001", "取得ISO9001，认证"), ("  ", "x"), (None, "x"), ("q", None)], "p string, s string")
    assert [r["g"] for r in df.select(norm.grounded(F.col("p"), F.col("s")).alias("g")).collect()] == [True, False, False, False]


LINES = ["", "   ", "12", "2020年3月", "1,234.50万元", "3/4/5", "认 证", "abc123", "单位：万元", "精密轴承  6,228.90  8,337.00  35.49", "本公司取得认证证书。", "产量 12345678901234567890123", "报告期内收入为12.5亿元，同比增长3.2%，其中海外占比4.5%，国内占比95.5%", "第三节 管理层讨论与分析......102"]


def test_scores_agree_with_the_document_cleaner(spark):
    assert values(spark, lines.table_score, LINES) == [cleaner.score(x) for x in LINES]
    assert cleaner.score("12") == 1.0 and cleaner.score("本公司取得认证证书。") == 0.0


def test_line_flags(spark):
    assert values(spark, lines.is_dot_leader, ["第三节 分析......102", "第三节 分析"]) == [True, False]
    assert values(spark, lines.is_probable_title, ["第三节 管理层讨论与分析", "详见第三节", "第三节，重要", "之", ""]) == [True, False, False, False, False]
    assert values(spark, lines.is_company_header, ["某某股份有限公司", "公司"]) == [True, False]


@pytest.mark.parametrize(("text", "want"), [("UN charter", True), ("JUNE", False), ("ISO9001", True), ("DISORDER", False)])
def test_term_boundaries(spark, text, want):
    assert values(spark, lambda c: lines.has_term(c, ["UN", "ISO"]), [text]) == [want]
