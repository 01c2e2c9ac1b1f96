import json

import pytest
from pyspark.sql import functions as F

from docmill import cli
from docmill.operators import extraction, provider, review
from docmill.operators.indicators import described, method_counts
from docmill.operators.lineblocks import anchored_context, lines_of
from docmill.operators.mapping import mapped_entities
from docmill.settings import Settings
from docmill.sources import reports, tables

TOML = """
[paths]
prompt_file = "prompts/x.txt"
[preprocess]
min_chapter_chars = 9
target_chapter_keywords = ["甲"]
[main_regression]
text_unit_min_chars = 600
[stage1]
workers = 16
max_retries = 5
[stage1.api]
base_url = "http://h/v1"
model = "m"
max_tokens = 256
[stage1.api.extra_body.chat_template_kwargs]
enable_thinking = false
[stage2.vllm_batch]
model_path = "/m"
chunk_size = 8
enable_lora = true
lora_path = ""
[stage2.local]
model_path = "/n"
max_input_chars = 0
[stage2.safe_recovery]
enabled = true
max_generation_attempts = 3
grounding_mode = "off"
"""


@pytest.fixture
def settings(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "a.toml").write_text(TOML, "utf-8")
    return Settings.load(tmp_path / "configs" / "a.toml")


def test_settings(settings, tmp_path, monkeypatch):
    assert settings.path("prompt_file") == str(tmp_path / "prompts" / "x.txt") and settings.section("none", "such") == {}
    assert settings.chapters().target_keywords == ("甲",) and settings.units().min_chars == 600 and settings.units().max_chars == 1200
    assert settings.retry("stage1").attempts == 5 and settings.retry("stage2").attempts == 3 and settings.workers("stage1") == 16 and settings.workers("stage2") is None
    assert settings.recovery() == extraction.Recovery(attempts=3, grounding=False) and not Settings({}, tmp_path).recovery().enabled
    with pytest.raises(ValueError):
        settings.http("stage1")
    monkeypatch.setenv("DOCMILL_API_KEY", "k")
    body = settings.http("stage1").body("s", "u")
    assert body["max_tokens"] == 256 and body["chat_template_kwargs"] == {"enable_thinking": False} and body["response_format"] == {"type": "json_object"}
    engine = settings.engine("stage2")
    assert engine.chunk == 8 and engine.engine_options()["max_lora_rank"] == 32 and engine.lora_path is None and engine.structured_output["required"] == ["standards"]
    assert settings.local("stage2").max_input_chars is None and settings.provider("stage2", "local").model_path == "/n"
    with pytest.raises(ValueError):
        settings.local("stage1")
    with pytest.raises(KeyError):
        settings.path("other")


def test_chat_text_falls_back():
    class Old:
        def apply_chat_template(self, messages, tokenize, add_generation_prompt, **more):
            if more:
                raise TypeError
            return messages[0]["content"] + "|" + messages[1]["content"]

    class None_:
        def apply_chat_template(self, *a, **k):
            raise ValueError("no template")

    assert provider.chat_text(Old(), "s", "u") == "s|u" and provider.chat_text(None_(), "s", "u").startswith("System:\ns\n\nUser:\nu")


def test_engine_is_built_once(monkeypatch):
    built = []

    class Engine:
        def get_tokenizer(self):
            return type("T", (), {"apply_chat_template": lambda self, m, **k: m[1]["content"]})()

        def generate(self, prompts, params, use_tqdm):
            return [type("O", (), {"outputs": [type("X", (), {"text": f" {p}:{params['max_tokens']} "})()] if p else []})() for p in prompts]

    class Vllm:
        SamplingParams = dict

        class sampling_params:
            class StructuredOutputsParams(dict):
                pass

    monkeypatch.setattr(provider.EngineProvider, "_build", lambda self: built.append(1) or (Vllm, Engine()))
    monkeypatch.setattr(provider, "_ENGINES", {})
    e = provider.EngineProvider("/m", structured_output={"type": "object"})
    assert e.complete_batch("s", ["a", ""]) == ["a:384", ""] and e.complete_batch("s", ["b"]) == ["b:384"] and built == [1]
    assert list(provider.structured_options(Vllm, {})) == ["structured_outputs"]


def test_prompts(spark):
    df = spark.createDataFrame([("u", "1", None, "2024", "正文")], "text_unit_id string, stock_code string, company_name string, year string, text string")
    r = df.select(provider.screening_prompt().alias("a"), provider.extraction_prompt().alias("b")).head()
    assert r["a"].split("\n")[1:] == ["text_unit_id: u", "text:", "---", "正文", "---"] and r["b"].split("\n")[1:5] == ["text_unit_id: u", "stock_code: 1", "company_name: ", "year: 2024"]


def test_looping_replies_fail_and_are_recorded(spark):
    def answer(_, user):
        good = '{"standards": [{"entity": "ISO 1", "type": "TYPE_A", "status": "NO", "evidence": "正文五字以上"}]}'
        return good if "好" in user else "项" * 100 if "环" in user else "broken"

    units = spark.createDataFrame([(t, "1", "c", "2024", t + "正文五字以上") for t in ("好", "环", "坏")], "text_unit_id string, stock_code string, company_name string, year string, text string")
    results, failures, audit = extraction.extract_units(units.unionByName(units), "", provider.StubProvider(answer), recovery=extraction.Recovery(retry_on_repetition=False))
    assert [r["entity"] for r in results.collect()] == ["ISO 1"] and audit.columns == extraction.AUDIT_COLUMNS
    got = {r["text_unit_id"]: r for r in failures.collect()}
    assert set(got) == {"环", "坏"} and got["环"]["error_type"] == "DegenerationError" and not got["环"]["retries_exhausted"] and got["坏"]["retries_exhausted"] and got["坏"]["raw_response"] == "broken"
    entries = {(r["text_unit_id"], r["attempt"]): r for r in audit.collect()}
    assert set(entries) == {("好", 1), ("环", 1), ("坏", 1), ("坏", 2)} and [entries[k]["final_disposition"] for k in (("好", 1), ("环", 1), ("坏", 1), ("坏", 2))] == ["success", "failed", "retry", "failed"]
    assert entries["好", 1]["evidence_grounded"] and entries["环", 1]["degeneration_flags"] == ["single_char_repeat"]


def test_strict_dates_in_the_mapping(spark):
    d = spark.createDataFrame([("GB/T 1-2010", "ISO 1", "IDT", "2010年1月2日", None, None, None), ("GB/T 1-2012", "ISO 2", "IDT", "2012-01-01", "9999-12-31", None, None)], "`标准号` string, `国际标准编号` string, `采标类型` string, `生效日期` string, `失效日期` string, `当前状态` string, `时间数据质量` string")
    r = spark.createDataFrame([("a", "GB/T 1", "TYPE_B", "ADOPTED", "2020")], "text_unit_id string, entity string, type string, status string, year string")
    assert mapped_entities(r, d).head()["国际标准"] == "ISO 2"


def test_anchors_split_over_cells(spark):
    text = "\n".join(["前文说明本年度的情况如下所示。", "认", "证", "有", "效", "后文继续说明相关的内容。"])
    long = "\n".join(["甲"] * 14 + ["认", "证"] + ["乙"] * 4)
    df = spark.createDataFrame([(1, text), (2, long), (3, "认\n\n证")], "i int, t string")
    got = {(r["i"], r["ln"]) for r in anchored_context(lines_of(df, ["i"], "t"), ["i"], ["认证"]).where("protected").collect()}
    assert got == {(1, k) for k in range(1, 5)} | {(2, k) for k in range(8, 18)}  # every window of six lines that holds the term, and two lines round it


def test_counts_of_methods(spark):
    s = spark.createDataFrame([("a", " Related", "OK"), ("b", "uncertain", "OK"), ("c", None, "error")], "text_unit_id string, relevance string, stage1_status string")
    assert tuple(method_counts("llm_only", s, s).head()) == (0, 1, 1) and method_counts("keyword", s).head()[0] == 3 and tuple(method_counts("llm_only", s).head()) == (0, 0, 0)
    r = described(spark.range(1).select(F.lit(3).alias("n")), "main", "2024", {"a": "/x"}, {}, {"stage1": None}, missing=1).head()
    assert r["workflow_id"].startswith("main_2024_2") and r["input_paths"] == {"a": "/x"} and not r["complete"] and r["n"] == 3


def test_recovery_and_sampling(spark, tmp_path):
    row = lambda u, e: (u, e, "TYPE_A", "NO", "v")
    schema = "text_unit_id string, entity string, type string, status string, evidence string"
    a, b = spark.createDataFrame([row("x", "1"), row("y", "1"), row("z", "1")], schema), spark.createDataFrame([row("x", "1"), row("y", "2"), row("w", "1")], schema)
    assert {tuple(r) for r in review.recovery_units(a, b).collect()} == {("y", "changed"), ("z", "lost"), ("w", "new")}
    for year in ("2023", "2024"):
        (tmp_path / f"{year}_x").mkdir()
        for i in range(4):
            (tmp_path / f"{year}_x" / f"00000{i}_{year}_n_r.txt").write_text("t")
    listed = reports.list_reports(spark, str(tmp_path))
    assert listed.count() == 8 and review.sample_reports(listed, 2).groupBy("year").count().where("count = 2").count() == 2 and review.sample_reports(listed, 0, "1").count() == 2


def test_csv_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([("a\n\"b\"", ["x", "y"])], "t string, l array<string>")
    tables.write_csv(df, str(tmp_path / "c.csv"))
    part = next((tmp_path / "c.csv").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbft,l") and tables.read_csv(spark, str(tmp_path / "c.csv"), "t string, l string").head()["l"] == "x;y"


def test_steps_of_the_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli.SparkSession.Builder, "getOrCreate", lambda self: spark)
    folder = tmp_path / "2024_年报"
    folder.mkdir()
    (folder / "000001_2024_甲公司_年度报告.txt").write_text("第一节 重要事项\n" + "公司通过ISO 9001认证，体系运行有效。" * 60, "utf-8")
    (tmp_path / "terms.txt").write_text("ISO\n", "utf-8")
    at = lambda n: str(tmp_path / n)
    run = lambda *a: cli.main(list(a))
    assert run("units", "--year", "2024", "--reports", str(tmp_path), "--terms", at("terms.txt"), "--out", at("units")) == 0
    assert run("units", "--year", "2024", "--reports", str(tmp_path), "--out", at("units")) == 1 and "--overwrite" in capsys.readouterr().err
    assert run("audit", "--units", at("units"), "--out", at("audit.csv")) == 0
    monkeypatch.setattr(cli, "_models", lambda a, s: cli.Models(provider.StubProvider(lambda s, u: '{"relevance": "related", "confidence_score": 1, "reason": ""}'), provider.StubProvider(lambda s, u: '{"standards": [{"entity": "ISO 9001", "type": "TYPE_A", "status": "ADOPTED", "evidence": "e"}]}')))
    assert run("screen", "--units", at("units"), "--out", at("screen"), "--failures", at("fail1")) == 0 and run("screen", "--units", at("units"), "--out", at("screen"), "--resume") == 0
    assert run("route", "--units", at("units"), "--screening", at("screen"), "--terms", at("terms.txt"), "--out", at("routed")) == 0
    assert run("extract", "--units", at("routed"), "--out", at("results"), "--limit", "1") == 0 and run("extract", "--units", at("routed"), "--out", at("results"), "--resume") == 0
    assert run("extract", "--units", at("routed"), "--out", at("none"), "--dry-run") == 0 and not (tmp_path / "none").exists()
    spark.createDataFrame([("GB/T 1-2010", "ISO 1", "IDT")], "`标准号` string, `国际标准编号` string, `采标类型` string").write.parquet(at("dict"))
    assert run("map", "--results", at("results"), "--dictionary", at("dict"), "--out", at("mapped")) == 0 and run("aggregate", "--units", at("units"), "--mapped", at("mapped"), "--out", at("final.csv")) == 0
    final = tables.read_csv(spark, at("final.csv"), "stock_code string, company_name string, year string, dummy int, n int").head()
    assert (final["stock_code"], final["dummy"], final["n"]) == ("000001", 1, 1)
    assert spark.read.parquet(at("results")).select("text_unit_id").distinct().count() == spark.read.parquet(at("units")).count()
    assert run("map", "--out", at("x")) == 1 and json.loads("1") == 1
