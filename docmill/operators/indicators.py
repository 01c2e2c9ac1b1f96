"""Firm-year indicators, their comparison across methods, and run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.norm import tolerant_bool
from docmill.operators.extraction import stage2_status

DUMMY, COUNT = "InternationalStandardDummy", "AdoptedEntityCount"
METHODS = ("main", "keyword", "llm_only", "full_llm")


def firm_years(units: DataFrame, mapped: DataFrame) -> DataFrame:
    """Every (stock_code, company_name, year) of the units with a dummy (any output) and the number of distinct adopted entities
    with output; 0 where there are none."""
    universe = units.select("stock_code", "company_name", "year").distinct()
    counted = mapped.groupBy("stock_code", "year").agg(F.max(F.coalesce(F.col("output").cast("int"), F.lit(0))).alias(DUMMY), F.count_distinct(F.when((F.col("output") == 1) & (F.col("status") == "ADOPTED"), F.col("entity"))).cast("int").alias(COUNT))
    return universe.join(counted, ["stock_code", "year"], "left").na.fill(0, [DUMMY, COUNT]).select("stock_code", "company_name", "year", DUMMY, COUNT)


def in_report_order(df: DataFrame, *more: str) -> DataFrame:
    """By the number of the stock code (unreadable last), then year, then more."""
    return df.orderBy(F.col("stock_code").try_cast("long").asc_nulls_last(), "year", *more)


def collected(finals: dict[str, DataFrame]) -> DataFrame:
    """The dummies of several methods side by side: a full outer join by firm and year; the name is the first method's that has one."""
    one = lambda m, df: df.groupBy("stock_code", "year").agg(F.max(DUMMY).alias(f"{DUMMY}_{m}"), F.min("company_name").alias(f"name_{m}"))
    joined = reduce(lambda a, b: a.join(b, ["stock_code", "year"], "full_outer"), [one(m, df) for m, df in finals.items()])
    return joined.select("stock_code", F.coalesce(*[f"name_{m}" for m in finals]).alias("company_name"), "year", *[f"{DUMMY}_{m}" for m in finals])


def consistency(side_by_side: DataFrame, base: str = "main", others: tuple[str, ...] = METHODS[1:]) -> DataFrame:
    """side_by_side with a flag for each other method: both known and equal."""
    for m in others:
        side_by_side = side_by_side.withColumn(f"{base}_eq_{m}", F.coalesce(F.col(f"{DUMMY}_{base}") == F.col(f"{DUMMY}_{m}"), F.lit(False)))
    return side_by_side


def manifest(units: DataFrame, features: DataFrame, screening: DataFrame, routed: DataFrame, results: DataFrame, queue: DataFrame | None, final: DataFrame) -> DataFrame:
    """One row of counts of a run, and whether it is complete: everything routed is completed, and nothing failed."""
    ids = lambda df, name: df.agg(F.count_distinct("text_unit_id").alias(name))
    parts = [
        ids(units, "text_units"),
        features.agg(F.count_distinct(F.when(tolerant_bool(F.col("keyword_candidate")), F.col("text_unit_id"))).alias("keyword_units")),
        screening.agg(*[F.count_distinct(F.when(F.lower(F.trim("relevance")) == r, F.col("text_unit_id"))).alias(f"screened_{r}") for r in ("related", "uncertain")], *[F.count_distinct(F.when(F.col("stage1_status") == s, F.col("text_unit_id"))).alias(n) for s, n in (("SKIPPED_KEYWORD", "screen_skipped"), ("ERROR", "screen_failed"))]),
        ids(routed, "routed"),
        stage2_status(results, queue, routed),
        final.agg(F.count(F.lit(1)).alias("firm_years"), F.count_if(F.col(DUMMY) == 1).alias("firm_years_with_output")),
    ]
    # Each part is one row.
    one = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), parts)
    return one.withColumn("pending", F.greatest(F.lit(0), F.col("routed") - F.col("completed") - F.col("failed"))).withColumn("complete", (F.col("routed") == F.col("completed")) & (F.col("failed") == 0) & (F.col("screen_failed") == 0))


def method_counts(method: str, units: DataFrame, screening: DataFrame | None = None) -> DataFrame:
    """One row of what counts for one method: its candidates, its units, or how its screening went."""
    if method == "keyword":
        return units.agg(F.count(F.lit(1)).alias("N_keyword_candidate"))
    if method == "full_llm":
        return units.agg(F.count(F.lit(1)).alias("N_full_units"))
    if screening is None:
        return units.sparkSession.range(1).select(*[F.lit(0).alias(c) for c in ("N_llm_related", "N_llm_uncertain", "N_stage1_failed")])
    told = F.lower("relevance")
    return screening.agg(F.count_if(told == "related").alias("N_llm_related"), F.count_if(told == "uncertain").alias("N_llm_uncertain"), F.count_if(F.upper("stage1_status") == "ERROR").alias("N_stage1_failed"))


def described(counts: DataFrame, method: str, year: str, inputs: dict[str, str], outputs: dict[str, str], models: dict[str, str | None], missing: int = 0, **more: str) -> DataFrame:
    """A manifest's one row of counts with what it was made of: an id, the method and year, paths, models, when, and further settings.

    ``missing`` is the number of required paths that don't exist; with any the run isn't complete.
    """
    paths = lambda d: F.create_map(*[x for k, v in sorted(d.items()) for x in (F.lit(k), F.lit(v))]) if d else F.create_map().cast("map<string,string>")
    now = F.current_timestamp()
    out = counts.withColumns({
        "workflow_id": F.concat_ws("_", F.lit(method), F.lit(year), F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")), "method": F.lit(method), "year": F.lit(year), "input_paths": paths(inputs), "output_paths": paths(outputs), "created_at": now,
        **{f"model_{k}": F.lit(v) for k, v in models.items()}, **{k: F.lit(v) for k, v in more.items()},
    })
    return out.withColumn("complete", F.col("complete") & F.lit(missing == 0)) if "complete" in counts.columns else out.withColumn("complete", F.lit(missing == 0))
