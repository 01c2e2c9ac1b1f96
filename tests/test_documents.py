import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.operators import cleaner, keywords
from docmill.operators.cleaner import ChapterSettings, UnitSettings
from docmill.plans import reference_queries

ANCHORS = cleaner.Anchors(["ISO"])


def test_split_cells_are_joined():
    assert cleaner.joined_cells(["污染", "苯", "有组", "织排", "放", "未超", "标"]) == "污染苯有组织排放未超标"
    assert cleaner.joined_cells(["1", "2,3", "x", "年"]) == "12,3 x 年"


def test_tables_go_unless_anchored():
    noise = "说明文字在这里，后面是表格内容。\n1,000\n2,000\n3,000\n4,000\n\n正文继续，没有数字。"
    assert cleaner.without_table_noise(noise, ANCHORS) == "说明文字在这里,后面是表格内容。\n\n正文继续,没有数字。"  # NFKC
    kept = "体系名称\nISO 9001\n证书号\n1234"
    assert "ISO 9001" in cleaner.without_table_noise(kept, ANCHORS)


def test_page_furniture():
    lines = ["甲股份有限公司", "甲 2024 年年度报告", "目录", "正文。", "12", "第一节 概况......3"]
    assert cleaner.without_page_furniture(lines, "2024") == ["正文。"]
    assert cleaner.without_page_furniture(["甲股份有限公司", "正文"], "2024") == ["甲股份有限公司", "正文"]


def test_chapters():
    body = "本公司经营情况良好。" * 60
    text = f"第二节 公司简介\n略\n第三节\n管理层讨论与分析\n{body}\n第三节 管理层讨论与分析\n续。详见第四节 公司治理，内容\n第四节 财务报告\n数"
    assert [t for t, _ in cleaner.chapters(text)] == ["第三节 管理层讨论与分析"]
    assert body in cleaner.chapters(text)[0][1] and "续。" in cleaner.chapters(text)[0][1]
    assert cleaner.chapters("没有章节") == [("全文", "没有章节")]
    assert cleaner.chapters("第三节 公司治理\n短", ChapterSettings()) == [("全文", "第三节 公司治理\n短")]


def test_units_keep_everything_and_their_bounds():
    text = "甲" * 79 + "。" + "乙" * 79 + "。"
    made = cleaner.units(text, UnitSettings(50, 120))
    assert len(made) > 1 and "".join(made) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="甲乙丙。！\n a1", max_size=400))
def test_units_lose_no_character(text):
    s = UnitSettings(20, 50)
    made = cleaner.units(text, s)
    tight = lambda x: "".join(x.split())
    assert tight("".join(made)) == tight(unicodedata.normalize("NFKC", text))
    assert all(len(u) <= s.overflow for u in made)


def test_terms():
    assert keywords.find_terms("符合ISO 9001与GB/T，CE，DISORDER", keywords.term_order(["ISO", "GB/T", "CE", "GB"])) == ["GB/T", "ISO", "CE"]


def test_report_units(spark):
    df = spark.createDataFrame([("000001", "甲", "2024", "f.txt", "第三节 公司治理\n" + "治理良好。" * 200), ("000002", "乙", "2024", "g.txt", None), ("000003", "丙", "2024", "h.txt", "")], "stock_code string, company_name string, year string, source_file string, text string")
    got = cleaner.text_units(df, unit=UnitSettings(100, 300)).collect()
    assert got[0]["text_unit_id"] == "000001_2024_00001" and {r["stock_code"] for r in got} == {"000001"}
    assert sum(len(r["text"].replace("\n", "")) for r in got) == 1000


def test_documents_without_a_code_give_units(spark, tmp_path):
    df = spark.createDataFrame([(1, "000001", "a", "2024-01-01", "治理良好。" * 200), (2, None, "b", "2024-01-01", "治理良好。" * 200)], "doc_id long, stock_code string, source string, published_at string, text string")
    df.withColumn("published_at", F.col("published_at").cast("timestamp")).write.parquet(str(tmp_path / "documents.parquet"))
    got = reference_queries.report_units(spark, str(tmp_path)).where("unit_order = 1").collect()
    assert {(r["source_file"], r["text_unit_id"], r["stock_code"]) for r in got} == {("1", "000001_2024_00001", "000001"), ("2", "NA_2024_00001", None)}


def test_clean_text_of_nulls(spark):
    df = spark.createDataFrame([(None, None), ("正文。", "x")], "t string, y string")
    assert [r["c"] for r in df.select(cleaner.clean_text(F.col("t"), F.col("y")).alias("c")).collect()] == ["", "正文。"]
