"""Every operator over the same awkward table: null ids, null, empty and very long texts, repeated rows, names that clash with inner ones."""

import pytest
from pyspark.sql import functions as F

from docmill.llm import canonical, chunk, confusable, leak, mixing, pii, repetition, scan_noise

LONG = "公司持续改进质量管理体系，记录完整，数据可查可追，编号2024。The quality of the report is high. " * 4000
CLASHES = ["i", "t", "k", "d", "dt", "h", "v", "v1", "value", "form", "seg", "pos", "kind", "kinds", "start", "stop", "salt", "lang", "band", "p", "q", "s", "at", "parts", "piece", "found", "body", "field", "known", "meant", "probability", "matched_code", "c0"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "正文。"), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "正文。"), (None, None), (5, "Ａ​́" * 50), (6, "퟿\U0001f600" * 30)]
    df = spark.createDataFrame(rows, "id long, txt string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def test_repetition(table):
    got = repetition.repetition(table, "id", "txt").collect()
    assert len(got) == 9 and all(r["repeated_share"] > 0.9 for r in got if r["id"] == 4)


def test_canonical(spark, table):
    ref = spark.createDataFrame([("正文", None), (None, "x"), ("正文", None), ("", "")], "code string, name string").select("*", F.lit(1).alias("term"), F.lit(1).alias("n"))
    for most in (10**6, 0):
        assert canonical.map_to_list(table, "txt", ref, "code", most_keys=most).where("matched_entry = '正文'").count() == 2
        assert canonical.map_to_standards(table, "txt", ref, "code", "name", most_keys=most).count() == 9


def test_chunk(table):
    got = chunk.split_oversized(table, "txt", 1200, 100)
    assert got.where("id = 4").count() == 2 * got.where("id = 4").select("_piece", "piece_no").distinct().count() and got.where("id is null").count() == 2


def test_confusable(table):
    assert {r["field_name"] for r in confusable.changed_values(table, "id", ["txt"]).collect()} == {"txt"}
    full = confusable.with_consistent(table, ["txt"])
    assert full.columns == table.columns and full.count() == 9 and full.where("id = 4").select("txt").distinct().head()[0] == LONG


def test_leak(spark, table):
    items = spark.createDataFrame([(1, LONG[:300]), (2, None), (None, LONG[:300]), (3, ""), (3, LONG[:300])], "item long, words string").select("*", F.lit(1).alias("i"), F.lit(1).alias("it"), F.lit(1).alias("shifts"))
    got = {(r["id"], r["item"]) for r in leak.leaked_items(table, "id", "txt", items, "item", "words").where("verbatim_run >= 50").collect()}
    assert got == {(4, 1), (4, 3)}


def test_scan_noise(table):
    wide = table.withColumn("title", F.col("txt")).withColumn("company", F.lit(None).cast("string")).withColumn("file", F.lit(None).cast("string"))
    got = scan_noise.repair_scans(wide, "id", "txt", "title", "company", "file").collect()
    assert len(got) == 18 and sum(r["repaired"] is None for r in got) == 4


def test_mixing(spark, table):
    sizes = table.select("id", F.lit("a").alias("src"), F.char_length("txt").alias("n"), "s", "d", "p")
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 1.0, 1)], "source string, target_share double, max_repeats int").select("*", F.lit(1).alias("s"))
    got = mixing.mix_sources(sizes, "id", "src", "n", targets).collect()
    assert all(1 <= r["copies"] <= 2 for r in got) and {r["id"] for r in got} >= {1, 4, None}


def test_pii(table):
    spans = pii.pii_spans(table.withColumn("txt", F.when(F.col("id") == 1, "联系人：欧阳宛白，电话：13800138000。").otherwise(F.col("txt"))), "id", "txt")
    assert {(r["id"], r["value"]) for r in spans.collect()} >= {(1, "欧阳宛白"), (1, "13800138000")}
    clean = pii.redacted(table, "id", "txt", spans)
    assert clean.columns == table.columns and clean.count() == 9
