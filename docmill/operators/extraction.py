"""Entity extraction in one or two passes, its resume and its bookkeeping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.norm import head_and_tail, truncated
from docmill.operators.provider import RETRY_SUFFIX, Provider, Retry, call_model, extraction_prompt
from docmill.operators.replies import MAX_RATIO, MIN_BYTES, NOTHING, degeneration_flags, entity_rows, grounding, lenient_reply, strict_reply
from docmill.operators.screening import last_by_id
from docmill.session import cut

RESULT_COLUMNS = ["text_unit_id", "stock_code", "company_name", "year", "entity", "type", "status", "evidence"]
MIN_TEXT = 5


AUDIT_COLUMNS = [
    "created_at", "text_unit_id", "attempt", "structured_output", "parse_method", "parse_success", "schema_valid", "repair_attempted", "repair_actions", "degeneration_flags",
    "entity_grounded", "evidence_grounded", "final_disposition", "raw_response_length", "raw_response_sha256", "raw_response_preview", "original_error_type", "parse_error",
]


@dataclass(frozen=True)
class Recovery:
    """Strict parsing with one repair, and further passes over what failed. Without it the first object anywhere counts."""

    enabled: bool = True
    attempts: int = 2
    grounding: bool = True
    structured_output: bool = True
    repair_once: bool = True
    detect_repetition: bool = True
    retry_on_parse_failure: bool = True
    retry_on_repetition: bool = True
    min_bytes: int = MIN_BYTES
    max_ratio: float = MAX_RATIO

    def __post_init__(self) -> None:
        if not 1 <= self.attempts <= 3:
            raise ValueError("attempts must be 1 to 3")


def is_failure() -> Column:
    """Sentinel rows of failed extractions: entity ERROR, type LLM_FAILURE or status FAIL, in any case."""
    same = lambda c, v: F.coalesce(F.upper(F.trim(c)) == v, F.lit(False))
    return same("entity", "ERROR") | same("type", "LLM_FAILURE") | same("status", "FAIL")


def successful_rows(results: DataFrame) -> DataFrame:
    return results.where(~is_failure())


def completed_ids(results: DataFrame) -> DataFrame:
    """Units that have a successful row; the results are the truth, logs are derived from this."""
    return successful_rows(results).where("text_unit_id is not null").select("text_unit_id").distinct()


def pending_units(units: DataFrame, results: DataFrame | None) -> DataFrame:
    """Units without a successful row."""
    return units if results is None else units.join(completed_ids(results), "text_unit_id", "left_anti")


def outcomes(asked: DataFrame, recovery: Recovery) -> DataFrame:
    """asked (with raw) plus items (null if it failed), method, errors, actions and flags (of a looping reply, which fails)."""
    nothing = F.array().cast("array<string>")
    if not recovery.enabled:
        out = asked.withColumn("items", lenient_reply(F.col("raw")))
        found = F.col("items").isNotNull()
        return out.withColumns({"method": F.when(found, "lenient").otherwise("none"), "errors": F.when(found, nothing).otherwise(F.array(F.lit("no object"))), "actions": nothing, "flags": nothing})
    flags = degeneration_flags(F.col("raw"), recovery.min_bytes, recovery.max_ratio) if recovery.detect_repetition else nothing
    out = asked.withColumn("flags", F.coalesce(flags, nothing)).withColumn("r", strict_reply(F.col("raw")))
    usable = (F.size("flags") == 0) & (F.lit(recovery.repair_once) | (F.col("r.method") != "repaired"))
    return out.select(*asked.columns, F.when(usable, F.col("r.items")).alias("items"), F.when(usable, F.col("r.method")).otherwise("none").alias("method"), F.when(F.size("flags") > 0, F.array(F.lit("repetition"))).otherwise(F.col("r.errors")).alias("errors"), "r.actions", "flags")


def audit_entries(asked: DataFrame, recovery: Recovery, last: bool) -> DataFrame:
    """One row of AUDIT_COLUMNS for every reply; ``last`` says whether a failure is final."""
    good, looping = F.col("items").isNotNull(), F.size("flags") > 0
    again = F.lit(not last) & (looping & F.lit(recovery.retry_on_repetition) | ~looping & F.lit(recovery.retry_on_parse_failure))
    error = F.coalesce("call_error", F.array_join("errors", "; "))
    kind = F.when(F.col("call_error").isNotNull(), F.substring_index("call_error", ":", 1)).when(looping, "DegenerationError").when(F.col("errors")[0].startswith("reply"), "SchemaError").otherwise("JSONDecodeError")
    full = asked.select(
        F.current_timestamp().alias("created_at"), "text_unit_id", "attempt", F.lit(recovery.structured_output).alias("structured_output"), F.col("method").alias("parse_method"), good.alias("parse_success"), good.alias("schema_valid"),
        (~looping & (F.col("method") != "strict") & F.lit(recovery.enabled and recovery.repair_once)).alias("repair_attempted"), F.col("actions").alias("repair_actions"), F.col("flags").alias("degeneration_flags"),
        F.when(good, "success").when(again, "retry").otherwise("failed").alias("final_disposition"), F.char_length(F.coalesce("raw", F.lit(""))).alias("raw_response_length"), F.sha2(F.coalesce("raw", F.lit("")), 256).alias("raw_response_sha256"), head_and_tail(F.col("raw")).alias("raw_response_preview"),
        F.when(~good, kind).alias("original_error_type"), F.when(~good, error).alias("parse_error"), "text", F.try_element_at("items", F.lit(1)).alias("first"),
    )
    full = grounding(full.withColumn("entity", F.col("first.entity")).withColumn("evidence", F.col("first.evidence")), "entity", "evidence", "text")
    for c in ("entity_grounded", "evidence_grounded"):
        full = full.withColumn(c, F.when(F.col("parse_success") & F.lit(recovery.grounding), F.col(c)))
    return full.select(*AUDIT_COLUMNS)


def failure_records(failed: DataFrame, stage: str, provider: str, attempts: int) -> DataFrame:
    """One record of every unit that failed: when, where, of which firm and year, why, and the reply."""
    return failed.select(
        F.current_timestamp().alias("created_at"), F.lit(stage).alias("stage"), F.lit(provider).alias("provider"), "text_unit_id", "stock_code", "company_name", "year", "attempt",
        F.coalesce(F.substring_index("call_error", ":", 1), F.when(F.size("flags") > 0, "DegenerationError").otherwise("ParseError")).alias("error_type"), F.coalesce("call_error", F.array_join("errors", "; ")).alias("error"),
        truncated(F.col("raw")).alias("raw_response"), (F.col("attempt") >= attempts).alias("retries_exhausted"),
    )


def extract_units(units: DataFrame, system: str, provider: Provider, done: DataFrame | None = None, recovery: Recovery = Recovery(), retry: Retry = Retry(), partitions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, failures, audit) of the units that ``done`` doesn't hold.

    Texts under five characters give a row of nothing without a call. Each pass is written to the shared folder before it
    is used; the next pass takes only units whose reply could not be parsed or loops, with a reminder in the prompt. failures has a
    record for every unit that no pass could read; audit one for every reply. Repeated units are asked once, with the greatest of their texts.
    """
    todo = pending_units(units, done).select("text_unit_id", "stock_code", "company_name", "year", "text")
    todo = last_by_id(todo, "text_unit_id", "text", "year")
    short = F.char_length(F.trim(F.coalesce("text", F.lit("")))) < MIN_TEXT
    nothing = todo.where(short).select("text_unit_id", "stock_code", "company_name", "year", *[F.lit(v).alias(k) for k, v in NOTHING.items()])
    open_ = todo.where(~short).withColumn("prompt", extraction_prompt())
    keep = ["text_unit_id", "stock_code", "company_name", "year"]
    attempts = recovery.attempts if recovery.enabled else 1
    results, audit, failures = nothing.select(*RESULT_COLUMNS), None, None
    for attempt in range(1, attempts + 1):
        asked = cut(outcomes(call_model(open_, system, "prompt", provider, retry, partitions), recovery).withColumn("attempt", F.lit(attempt)))
        results = results.unionByName(entity_rows(asked.where("items is not null").select(*keep, "items"), "items").select(*RESULT_COLUMNS))
        entries = audit_entries(asked, recovery, attempt == attempts)
        audit = entries if audit is None else audit.unionByName(entries)
        failed, looping = asked.where("items is null"), F.size("flags") > 0
        again = (looping & F.lit(recovery.retry_on_repetition)) | (~looping & F.lit(recovery.retry_on_parse_failure))
        given_up = failed if attempt == attempts else failed.where(~again)
        records = failure_records(given_up, "stage2", type(provider).__name__, attempts)
        failures = records if failures is None else failures.unionByName(records)
        open_ = failed.where(again).select(*open_.columns).withColumn("prompt", F.concat("prompt", F.lit(RETRY_SUFFIX if attempt == 1 else "")))
    return results, failures, audit


def stage2_status(results: DataFrame, queue: DataFrame | None = None, routed: DataFrame | None = None) -> DataFrame:
    """One row: completed units, and failed ones (queued or with a sentinel) that aren't completed; only routed ones if given."""
    done = completed_ids(results)
    bad = results.where(is_failure()).select("text_unit_id")
    if queue is not None:
        bad = bad.unionByName(queue.select("text_unit_id"))
    bad = bad.where("text_unit_id is not null and text_unit_id <> ''").distinct().join(done, "text_unit_id", "left_anti")
    if routed is not None:
        ids = routed.select("text_unit_id").distinct()
        done, bad = done.join(ids, "text_unit_id", "left_semi"), bad.join(ids, "text_unit_id", "left_semi")
    both = done.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return both.agg(F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"))


def seed_results(targets: DataFrame, source: DataFrame, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): successful rows of another run for targets that aren't done, and targets left without one."""
    ids = targets.select("text_unit_id").distinct()
    if done is not None:
        ids = ids.join(completed_ids(done), "text_unit_id", "left_anti")
    rows = successful_rows(source).join(ids, "text_unit_id", "left_semi")
    return rows, ids.join(rows.select("text_unit_id").distinct(), "text_unit_id", "left_anti")
