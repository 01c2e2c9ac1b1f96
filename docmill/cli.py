"""Command line: single steps over tables, whole runs and their comparison.

Tables are Parquet folders, or CSV where the name ends in .csv. Settings come from a TOML file (--settings), models from its
sections with --provider, or from --base-url; without either a stub answers.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import cleaner, extraction, indicators, keywords, mapping, screening
from docmill.operators.indicators import DUMMY, described, method_counts
from docmill.operators.provider import HttpProvider, StubProvider
from docmill.plans.pipeline import Models, compared, main_run, read_run, variant_run, write_run
from docmill.session import drop_cuts
from docmill.settings import Settings
from docmill.sources.reports import read_reports, read_terms, report_dir
from docmill.sources.tables import append_json_lines, exists, require, write_csv

RUNS = ("main", "keyword", "llm_only", "full_llm")
STEPS = ("units", "audit", "screen", "route", "extract", "map", "aggregate")
COMMANDS = (*RUNS, "compare", *STEPS)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docmill", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--year", help="for runs and for the folder of reports")
    p.add_argument("--settings", help="TOML file")
    p.add_argument("--reports", help="folder that holds year_* folders of .txt reports")
    p.add_argument("--dictionary", help="table of the standards dictionary")
    p.add_argument("--terms", help="file of keywords, one a line")
    p.add_argument("--out", required=True, help="folder of the runs, or a step's output table")
    p.add_argument("--units", help="table of text units")
    p.add_argument("--features", help="table of keyword features")
    p.add_argument("--screening", help="table of the screening")
    p.add_argument("--results", help="table of extracted entities")
    p.add_argument("--mapped", help="table of mapped entities")
    p.add_argument("--failures", help="folder of JSON lines that failures are added to")
    p.add_argument("--provider", choices=("api", "local", "vllm_batch"))
    p.add_argument("--base-url", default=os.environ.get("DOCMILL_BASE_URL"))
    p.add_argument("--model", default=os.environ.get("DOCMILL_MODEL", ""))
    p.add_argument("--screen-prompt", default="", help="file of the system prompt")
    p.add_argument("--extract-prompt", default="", help="file of the system prompt")
    p.add_argument("--limit", type=int, help="work on so many units, the first by id")
    p.add_argument("--resume", action="store_true", help="keep what an earlier output holds")
    p.add_argument("--overwrite", action="store_true", help="replace an output that exists")
    p.add_argument("--dry-run", action="store_true", help="read and plan, but write nothing")
    return p


def _read(spark: SparkSession, path: str | None, name: str, columns: list[str] | None = None) -> DataFrame:
    if not path:
        raise ValueError(f"--{name} is needed")
    df = spark.read.csv(path, header=True, escape='"', multiLine=True) if path.endswith(".csv") else spark.read.parquet(path)
    return require(df, columns or [], path)


def _write(a: argparse.Namespace, df: DataFrame) -> None:
    if a.dry_run:
        df.explain("formatted")
        return
    if not a.overwrite and exists(df.sparkSession, a.out):
        raise FileExistsError(f"{a.out} exists; --overwrite replaces it")
    if a.out.endswith(".csv"):
        write_csv(df, a.out)
    else:
        df.write.mode("overwrite").parquet(a.out)


def _prompt(path: str) -> str:
    """The text of a prompt file, or of the argument itself where there is no such file."""
    return Path(path).read_text("utf-8").strip() if path and Path(path).is_file() else path


def _models(a: argparse.Namespace, s: Settings) -> Models:
    stub = HttpProvider(a.base_url, a.model, os.environ.get("DOCMILL_API_KEY", "")) if a.base_url else StubProvider()
    one = lambda stage: s.provider(stage, a.provider) if a.provider else stub
    recovery = s.recovery() if s.section("stage2", "safe_recovery") else extraction.Recovery()
    return Models(one("stage1"), one("stage2"), _prompt(a.screen_prompt), _prompt(a.extract_prompt), s.retry("stage2"), recovery, s.workers("stage2"))


def _step(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    units = lambda: screening.head_units(_read(spark, a.units, "units", screening.UNIT_COLUMNS), a.limit)
    terms = read_terms(spark, a.terms) if a.terms else []
    earlier = _read(spark, a.out, "out") if a.resume and exists(spark, a.out) else None
    if a.command == "units":
        _write(a, cleaner.text_units(read_reports(spark, report_dir(spark, a.reports, a.year)), chapter=s.chapters(), unit=s.units(), terms=terms))
    elif a.command == "audit":
        _write(a, cleaner.noise_audit(units(), terms))
    elif a.command == "screen":
        m = _models(a, s)
        features = _read(spark, a.features, "features", ["text_unit_id", "keyword_candidate"]) if a.features else None
        done = screening.screen_units(units(), m.screen_prompt, m.screen, features, earlier, s.retry("stage1"), s.workers("stage1"))
        _save_resumed(a, done)
        if a.failures and not a.dry_run:
            append_json_lines(screening.screening_failures(_read(spark, a.out, "out")), a.failures)
    elif a.command == "route":
        u = units()
        features = _read(spark, a.features, "features") if a.features else keywords.keyword_features(u, terms)
        _write(a, screening.route_units(u, features, _read(spark, a.screening, "screening", screening.SCREEN_COLUMNS[:2])))
    elif a.command == "extract":
        m = _models(a, s)
        results, failures, _ = extraction.extract_units(units(), m.extract_prompt, m.extract, earlier, m.recovery, m.retry, m.partitions)
        _save_resumed(a, results if earlier is None else extraction.successful_rows(earlier).select(*extraction.RESULT_COLUMNS).unionByName(results))
        if a.failures and not a.dry_run:
            append_json_lines(failures, a.failures)
    elif a.command == "map":
        _write(a, mapping.mapped_entities(_read(spark, a.results, "results", extraction.RESULT_COLUMNS), _read(spark, a.dictionary, "dictionary")))
    else:
        _write(a, indicators.firm_years(_read(spark, a.units, "units", ["stock_code", "company_name", "year"]), _read(spark, a.mapped, "mapped")))


def _save_resumed(a: argparse.Namespace, df: DataFrame) -> None:
    """An output that was read to resume from is replaced only once the new one stands beside it."""
    if not a.resume or a.dry_run or not exists(df.sparkSession, a.out):
        return _write(a, df)
    new = argparse.Namespace(**{**vars(a), "out": a.out.removesuffix(".csv") + "-new" + (".csv" if a.out.endswith(".csv") else ""), "overwrite": True})
    _write(new, df)
    fs_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(a.out).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.delete(fs_path(a.out), True)
    fs.rename(fs_path(new.out), fs_path(a.out))


def _whole(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    here = lambda name: f"{a.out}/{a.year}/{name}"
    if a.command == "compare":
        finals = {m: here(m) for m in RUNS}
        table = compared({m: read_run(spark, p).tables["final"] for m, p in finals.items()})
        table.write.mode("overwrite").parquet(here("comparison"))
        counts = spark.read.parquet(here("comparison")).selectExpr("count(*) as firm_years", f"count_if({DUMMY}_main = 1) as N_output_1")
        described(counts, "comparison", a.year, finals, {"comparison": here("comparison")}, {}).write.mode("overwrite").json(here("comparison-manifest"))
        return
    models = _models(a, s)
    dictionary = _read(spark, a.dictionary, "dictionary")
    if a.command == "main":
        done = read_run(spark, here("main")) if a.resume else None
        run = main_run(read_reports(spark, report_dir(spark, a.reports, a.year)), read_terms(spark, a.terms), dictionary, models, s.chapters(), s.units(), done)
    else:
        run = variant_run(a.command, read_run(spark, here("main")), dictionary, models)
    out = here(a.command) + ("-new" if a.resume else "")
    write_run(run, out)
    written = read_run(spark, out)
    counts = written.manifest().join(F.broadcast(method_counts(a.command, written.tables["routed"], written.tables["screening"])), F.lit(True))  # one row each
    names = {"stage1": getattr(models.screen, "model", type(models.screen).__name__), "stage2": getattr(models.extract, "model", type(models.extract).__name__)}
    described(counts, a.command, a.year, {"reports": a.reports or "", "terms": a.terms or "", "dictionary": a.dictionary, "settings": a.settings or ""}, {"run": out}, names, prompt_stage1=a.screen_prompt, prompt_stage2=a.extract_prompt).write.mode("overwrite").json(f"{out}/manifest")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("docmill").getOrCreate()
    try:
        s = Settings.load(a.settings) if a.settings else Settings({}, Path.cwd())
        (_step if a.command in STEPS else _whole)(spark, a, s)
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    finally:
        drop_cuts(spark)


if __name__ == "__main__":
    sys.exit(main())
