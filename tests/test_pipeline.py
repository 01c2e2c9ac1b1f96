import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.operators import extraction, indicators, mapping, replies, review, screening
from docmill.operators.provider import Retry, StubProvider, call_model
from docmill.plans.pipeline import Models, Run, compared, run_from_units, variant_run
from docmill.sources import reports, tables
from docmill.streaming.incremental import run_incremental, unit_stream

UNIT = "text_unit_id string, stock_code string, company_name string, year string, source_file string, chapter_title string, unit_order int, text string"
DICT = "`标准号` string, `国际标准编号` string, `采标类型` string, `生效日期` string, `失效日期` string, `当前状态` string, `时间数据质量` string"


def unit(i, text, code="000001"):
    return (f"{code}_2024_{i:05d}", code, f"名{code}", "2024", "f.txt", "全文", i, text)


def asof(spark, entity, year, rows):
    d = spark.createDataFrame(rows, DICT)
    w = spark.createDataFrame([(entity, year)], "entity string, year string")
    return [(r["code"], r["international"]) for r in mapping.asof_mapping(w, "entity", "year", d).collect()]


def test_asof_mapping(spark):
    two = [("GB/T 13471-2008", None, None, "2009-05-01", "2026-05-01", None, None), ("GB/T 13471-2025", "ISO 1", None, "2026-05-01", None, None, None)]
    assert asof(spark, "GB/T 13471", "2020", two) == [("GB/T 13471-2008", None)]
    assert asof(spark, "GB/T 13471", "2026", two) == [("GB/T 13471-2025", "ISO 1")]
    assert asof(spark, "GB/T 13471-2020", "2026", two) == []
    old = [("GB/T 17650.2-1998", "IEC 60754-2:1991", None, None, "2021-11-01", "废止", None), ("GB/T 17650.2-2021", "IEC 60754-2:2019", None, "2021-11-01", None, None, None)]
    assert asof(spark, "GB/T 17650.2", "2020", old) == [("GB/T 17650.2-1998", "IEC 60754-2:1991")]
    assert asof(spark, "GB/T 17650.2-2021", "2020", old) == []
    assert asof(spark, "GB/T 17650.2-2021", "2021", old) == [("GB/T 17650.2-2021", "IEC 60754-2:2019")]


def test_mapped_output(spark):
    d = spark.createDataFrame([("GB/T 19001-2016", "ISO 9001", "IDT", None, None, None, None)], DICT)
    r = spark.createDataFrame([("a", "GB/T 19001-2016", "TYPE_B", "ADOPTED", "2020"), ("b", "X 1", "TYPE_B", "ADOPTED", None), ("c", "CE", "TYPE_A", "NO", "2020"), ("d", "CE", "TYPE_C", "ADOPTED", "2020"), ("e", None, None, None, None)], "text_unit_id string, entity string, type string, status string, year string")
    got = {x["text_unit_id"]: (x["国际标准"], x["output"]) for x in mapping.mapped_entities(r, d).collect()}
    assert got == {"a": ("ISO 9001", 1), "b": (None, 0), "c": ("CE", 0), "d": ("CE", 1), "e": (None, 0)}


def test_replies():
    good = '{"standards": [{"entity": "e", "type": "TYPE_A", "status": "NO", "evidence": "v"}]}'
    assert replies.parse_reply(good)["method"] == "strict"
    assert replies.parse_reply(good.replace('"v"}]', '"v"},]'))["actions"] == ["removed_trailing_comma"]
    assert replies.parse_reply(f"```json\n{good}\n```")["method"] == "strict"
    assert replies.parse_reply(good.replace('"entity": "e"', '"entity"：3'))["method"] == "none"
    assert replies.parse_reply('{"standards": [{"entity": "a "b" c"}]}')["method"] == "none"
    assert replies.parse_reply(None)["errors"] == ["empty"]
    assert replies.payload_errors({"standards": [{"entity": 1, "type": "X", "status": "NO", "more": 1}]}) == ["reply.standards[0]: unexpected more", "reply.standards[0]: evidence is missing", "reply.standards[0].entity: int instead of str", "reply.standards[0].type: X is unknown"]
    assert replies.payload_errors([]) == ["reply: list instead of dict"] and replies.payload_errors({"more": 1}) == ["reply: unexpected more", "reply: standards is missing"]
    assert replies.json_schema()["properties"]["standards"]["items"]["properties"]["status"] == {"type": "string", "enum": ["ADOPTED", "PENDING", "NO"]}
    assert replies.lenient_items('noise {"standards": []} tail') == [replies.NOTHING]
    assert replies.lenient_items('{"standards": [{"type": "type_b", "status": "?"}]}') == [{"entity": "无", "type": "TYPE_B", "status": "NO", "evidence": "未发现相关描述"}]
    assert replies.lenient_items("nothing") is None and replies.lenient_items("") is None


def test_degeneration(spark):
    df = spark.createDataFrame([(1, "项" * 100), (2, "abc"), (3, None), (4, "甲乙丙丁" * 25 * 6), (5, "".join(chr(0x4E00 + i * 7 % 499) for i in range(499)) * 6)], "i int, raw string")
    got = {r["i"]: r["f"] for r in df.select("i", replies.degeneration_flags(F.col("raw")).alias("f")).collect()}
    assert got[1] == ["single_char_repeat"] and got[2] == [] and got[3] == [] and "long_segment_repeat" in got[4] and "long_segment_repeat" in got[5]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n", min_size=1, max_size=200), st.integers(1, 8), st.text(alphabet="ab\n", max_size=100))
def test_long_segments_as_by_pattern(segment, times, rest):
    text = rest + segment * times + rest
    assert replies.long_segment_repeats(text, 20, 5) == bool(re.search(r"(.{20,}?)\1{4,}", text))


def test_screening_reply(spark):
    raws = ['{"relevance": "Related", "confidence_score": 1.7, "reason": " r "}', '{"relevance": "x", "reason": "a "b" c", "confidence_score": 0.5}', "broken", None, '{"relevance": "related", "confidence_score": "NaN"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [tuple(r["r"]) for r in df.select("i", replies.screening_reply(F.col("raw")).alias("r")).orderBy("i").collect()]
    assert got[0] == ("related", 1.0, "r", "OK") and got[1][:2] == ("uncertain", 0.5) and got[2][3] == got[3][3] == "ERROR" and got[4][1] == 0.0


def test_failed_calls_are_kept(spark):
    def fail(_, user):
        raise RuntimeError("down")

    got = call_model(spark.createDataFrame([("p",)], "prompt string"), "", "prompt", StubProvider(fail), Retry(2, 0, 0)).collect()
    assert [(r["raw"], r["attempts"], r["call_error"]) for r in got] == [(None, 2, "RuntimeError: down")]


class Short:
    chunk = 2

    def complete_batch(self, system, users):
        if "boom" in users:
            raise RuntimeError("engine")
        return [u.upper() for u in users][:1]


def test_batches_lose_no_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "boom"), (4, None)], "i int, prompt string").coalesce(1)
    got = {r["i"]: (r["raw"], r["call_error"]) for r in call_model(df, "", "prompt", Short()).collect()}
    assert got == {1: ("A", None), 2: (None, "no reply"), 3: (None, "RuntimeError: engine"), 4: (None, "RuntimeError: engine")}


def test_routes_and_variants(spark):
    u = spark.createDataFrame([unit(i, "t") for i in range(1, 5)], UNIT)
    ids = [f"000001_2024_{i:05d}" for i in range(1, 5)]
    f = spark.createDataFrame([(ids[0], True, "ISO"), (ids[0], True, "ISO")], "text_unit_id string, keyword_candidate boolean, matched_terms string")
    s = spark.createDataFrame([(i, r, 0.5, "", "OK", "") for i, r in zip(ids[1:], ("related", " Uncertain", "unrelated"))], "text_unit_id string, relevance string, confidence_score double, reason string, stage1_status string, stage1_error string")
    got = {r["text_unit_id"]: r["route_reason"] for r in screening.route_units(u, f, s).collect()}
    assert got == {ids[0]: "keyword", ids[1]: "stage1_related", ids[2]: "stage1_uncertain"}
    sets = {m: sorted(r["text_unit_id"] for r in screening.variant_units(m, u, f, s).collect()) for m in ("keyword", "llm_only", "full_llm")}
    assert sets == {"keyword": ids[:1], "llm_only": ids[1:3], "full_llm": ids}


class Flaky:
    """Extracts ISO codes; replies nonsense for units with 坏 until healed."""

    def __init__(self, healed):
        self.healed = healed

    def complete(self, system, user):
        if system == "screen":
            return json.dumps({"relevance": "related" if "相关" in user else "unrelated", "confidence_score": 0.9, "reason": "r"})
        if "坏" in user and not self.healed:
            return "no json"
        found = re.findall(r"ISO \d+", user)
        return json.dumps({"standards": [{"entity": x, "type": "TYPE_A", "status": "ADOPTED", "evidence": x} for x in found]})


def test_fail_then_resume_then_variants(spark):
    u = spark.createDataFrame([unit(1, "公司取得ISO 9001认证。"), unit(2, "相关内容，没有标准。"), unit(3, "相关，坏，ISO 14001。"), unit(4, "其他内容在这里。", "000002")], UNIT)
    d = spark.createDataFrame([], DICT)
    models = lambda healed: Models(Flaky(healed), Flaky(healed), "screen", "extract", Retry(1, 0, 0))
    first = run_from_units(u, ["ISO"], d, models(False))
    m = first.manifest().head()
    assert (m["routed"], m["completed"], m["failed"], m["pending"], m["complete"]) == (3, 2, 1, 0, False)
    assert first.failures.count() == 1 and first.audit.count() == 4  # the second pass asks once more
    again = run_from_units(u, ["ISO"], d, models(True), Run({"screening": first.tables["screening"], "results": first.tables["results"]}))
    m = again.manifest().head()
    assert (m["completed"], m["failed"], m["complete"]) == (3, 0, True)
    final = {r["stock_code"]: (r[indicators.DUMMY], r[indicators.COUNT]) for r in again.tables["final"].collect()}
    assert final == {"000001": (1, 2), "000002": (0, 0)}
    finals = {"main": again.tables["final"]} | {v: variant_run(v, again, d, models(True)).tables["final"] for v in ("keyword", "llm_only", "full_llm")}
    side = {r["stock_code"]: r for r in compared(finals).collect()}
    assert side["000001"]["main_eq_keyword"] and side["000001"]["main_eq_full_llm"] and not side["000002"]["main_eq_keyword"]


def test_review(spark):
    cols = "text_unit_id string, stock_code string, company_name string, year string, entity string, type string, status string, evidence string"
    r = spark.createDataFrame([("a", "1", "n", "2024", "ERROR", "LLM_FAILURE", "FAIL", ""), ("b", "1", "n", "2024", "ERROR", "LLM_FAILURE", "FAIL", ""), ("c", "1", "n", "2024", "ok", "TYPE_A", "NO", "")], cols)
    v = spark.createDataFrame([("a", "1", "n", "2024", "ISO 1", "TYPE_A", "ADOPTED", "e"), ("b", "1", "n", "2024", None, "TYPE_A", "ADOPTED", "e")], cols)
    assert sorted((x["text_unit_id"], x["entity"]) for x in review.apply_review(r, v).collect()) == [("a", "ISO 1"), ("b", "ERROR"), ("c", "ok")]
    assert [x["problem"] for x in review.review_errors(v).collect()] == ["entity is missing"]
    rep = review.recovery_report(r, review.apply_review(r, v)).head()
    assert (rep["lost"], rep["new"], rep["changed"]) == (0, 1, 0)
    assert extraction.stage2_status(r).head()["failed"] == 2


def test_sample_is_the_same_whatever_the_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    draw = lambda n: sorted(r["k"] for r in review.sample_per_group(df.repartition(n), "g", "k", 5).collect())
    assert draw(1) == draw(7) and len(draw(3)) == 15


def test_sources(spark, tmp_path):
    folder = tmp_path / "reports" / "2024_x"
    folder.mkdir(parents=True)
    (folder / "000001_2024_甲_年度报告.txt").write_bytes("正文".encode("gb18030"))
    (folder / "000002_乙_2024年年度报告.txt").write_bytes("x".encode())
    (folder / "000003_丙_2024_y.txt").write_bytes("正文".encode())
    path = reports.report_dir(spark, str(tmp_path / "reports"), "2024")
    got = {r["stock_code"]: (r["company_name"], r["year"], r["text"]) for r in reports.read_reports(spark, path).collect()}
    assert got == {"000001": ("甲", "2024", "正文"), "000003": ("丙", "2024", "正文")}
    with pytest.raises(FileNotFoundError):
        reports.report_dir(spark, str(tmp_path / "reports"), "2023")
    (tmp_path / "k.txt").write_text("# c\nISO\n\nGB/T\nISO\n")
    assert reports.read_terms(spark, str(tmp_path / "k.txt")) == ["GB/T", "ISO"]
    df = spark.createDataFrame([('a"b\\c\nd', ["x", "y"])], "s string, l array<string>")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "s string, l string").head() == ('a"b\\c\nd', "x;y")
    assert tables.read_csv(spark, str(tmp_path / "none"), "s string").count() == 0
    (tmp_path / "q.json").write_text('{"text_unit_id": "a"}\n\nbroken\n{"text_unit_id": ""}\n{"text_unit_id": "a"}\n')
    assert [r[0] for r in tables.queued_ids(spark, str(tmp_path / "q.json")).collect()] == ["a"]
    with pytest.raises(tables.SchemaError):
        tables.require(df, ["s", "z"], "df")


def test_stream_writes_every_unit_once(spark, tmp_path):
    u = spark.createDataFrame([unit(i, f"ISO {i}") for i in range(1, 6)], UNIT)
    u.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = u.schema.simpleString()[7:-1].replace(":", " ")
    make = lambda df, _: df.selectExpr("text_unit_id", "stock_code", "company_name", "year", "text as entity", "'TYPE_A' as type", "'NO' as status", "'' as evidence")
    for k in range(2):
        run_incremental(unit_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / f"cp{k}"), make).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
