"""The whole analysis as one plan: units, keywords, screening, routing, extraction, mapping, firm-years; its variants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from docmill.operators.cleaner import ChapterSettings, UnitSettings, text_units
from docmill.operators.extraction import Recovery, extract_units, seed_results
from docmill.operators.indicators import collected, consistency, firm_years, manifest
from docmill.operators.keywords import keyword_features
from docmill.operators.mapping import mapped_entities
from docmill.operators.provider import Provider, Retry
from docmill.operators.screening import route_units, screen_units, variant_units
from docmill.session import cut

STAGES = ("units", "features", "screening", "routed", "results", "mapped", "final")


@dataclass
class Models:
    """The two models with their prompts."""

    screen: Provider
    extract: Provider
    screen_prompt: str = ""
    extract_prompt: str = ""
    retry: Retry = Retry()
    recovery: Recovery = Recovery()
    partitions: int | None = None


@dataclass
class Run:
    """The tables of a run by stage, its failures, audit and manifest."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    failures: DataFrame | None = None
    audit: DataFrame | None = None

    def manifest(self) -> DataFrame:
        t = self.tables
        return manifest(t["units"], t["features"], t["screening"], t["routed"], t["results"], self.failures, t["final"])


def _finish(run: Run, universe: DataFrame, dictionary: DataFrame) -> Run:
    run.tables["mapped"] = mapped_entities(run.tables["results"], dictionary)
    run.tables["final"] = firm_years(universe, run.tables["mapped"])
    return run


def main_run(reports: DataFrame, terms: list[str], dictionary: DataFrame, models: Models, chapter: ChapterSettings = ChapterSettings(), unit: UnitSettings = UnitSettings(), done: Run | None = None) -> Run:
    """Everything from report texts; a former run's screening and results are kept."""
    units = cut(text_units(reports, chapter=chapter, unit=unit, terms=terms))
    return run_from_units(units, terms, dictionary, models, done)


def run_from_units(units: DataFrame, terms: list[str], dictionary: DataFrame, models: Models, done: Run | None = None) -> Run:
    """Everything after the units were built."""
    features = cut(keyword_features(units, terms))
    old = done.tables if done else {}
    screening = cut(screen_units(units, models.screen_prompt, models.screen, features, old.get("screening"), models.retry, models.partitions))
    routed = cut(route_units(units, features, screening))
    results, failures, audit = extract_units(routed, models.extract_prompt, models.extract, old.get("results"), models.recovery, models.retry, models.partitions)
    if old.get("results") is not None:
        results = old["results"].unionByName(results)
    run = Run({"units": units, "features": features, "screening": screening, "routed": routed, "results": results}, failures, audit)
    return _finish(run, units, dictionary)


def variant_run(method: str, main: Run, dictionary: DataFrame, models: Models) -> Run:
    """A robustness variant: its units, results taken over from the main run, the rest extracted, the same tail.

    llm_only is screened on its own, without the keyword shortcut. Firms without units in the variant aren't in its result.
    """
    t = main.tables
    screening = cut(screen_units(t["units"], models.screen_prompt, models.screen, None, None, models.retry, models.partitions)) if method == "llm_only" else t["screening"]
    units = cut(variant_units(method, t["units"], t["features"], screening))
    seeded, missing = seed_results(units, t["results"])
    rest, failures, audit = extract_units(units.join(missing, "text_unit_id", "left_semi"), models.extract_prompt, models.extract, None, models.recovery, models.retry, models.partitions)
    run = Run(t | {"routed": units, "screening": screening, "results": seeded.unionByName(rest)}, failures, audit)
    return _finish(run, units, dictionary)


def compared(finals: dict[str, DataFrame]) -> DataFrame:
    """The methods' firm-year dummies side by side with flags of agreement with the main run."""
    return consistency(collected(finals))


def write_run(run: Run, path: str) -> None:
    """The stages as Parquet, failures and audit as JSON lines, the manifest as JSON. What the run has cut can be dropped afterwards (session.drop_cuts)."""
    for name in STAGES:
        if name in run.tables:
            run.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    if run.failures is not None:
        run.failures.write.mode("overwrite").json(f"{path}/failures")
        run.audit.write.mode("overwrite").json(f"{path}/audit")
    run.manifest().write.mode("overwrite").json(f"{path}/manifest")


def read_run(spark: SparkSession, path: str) -> Run:
    """A written run, to resume from or to build variants on."""
    return Run({name: spark.read.parquet(f"{path}/{name}") for name in STAGES})


def remove_run(spark: SparkSession, path: str) -> None:
    """Delete one written run, so that the next one starts afresh; other runs stay."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
