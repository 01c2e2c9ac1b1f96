"""Relevance screening with resume, and routing of units to extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.norm import tolerant_bool
from docmill.operators.provider import Provider, Retry, call_model, screening_prompt
from docmill.operators.replies import screening_reply
from docmill.session import cut

UNIT_COLUMNS = ["text_unit_id", "stock_code", "company_name", "year", "source_file", "chapter_title", "unit_order", "text"]
SCREEN_COLUMNS = ["text_unit_id", "relevance", "confidence_score", "reason", "stage1_status", "stage1_error"]
FORWARDED = ("related", "uncertain")


def last_by_id(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: the last in the order. The aggregate combines before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.`{c}`").alias(c) for c in df.columns])


def skipped_units(features: DataFrame) -> DataFrame:
    """Rows for units that a keyword already decides."""
    hit = features.where(tolerant_bool(F.col("keyword_candidate"))).select("text_unit_id").distinct()
    return hit.select("text_unit_id", F.lit("related").alias("relevance"), F.lit(None).cast("double").alias("confidence_score"), F.lit("keyword hit").alias("reason"), F.lit("SKIPPED_KEYWORD").alias("stage1_status"), F.lit("").alias("stage1_error"))


def screen_units(units: DataFrame, system: str, provider: Provider, features: DataFrame | None = None, done: DataFrame | None = None, retry: Retry = Retry(), partitions: int | None = None) -> DataFrame:
    """One screening row of every unit: kept from ``done`` unless it was an error, decided by keyword, or asked of the model.

    The anti-joins come before the model is called. Replies without a relevance, and calls that failed, become ERROR rows;
    none is lost. Repeated units are asked once, with the greatest of their texts. The new replies are written to the shared folder before they are used.
    """
    todo = last_by_id(units.select("text_unit_id", "text"), "text_unit_id", "text")
    parts = []
    if done is not None:
        kept = last_by_id(done.where("stage1_status <> 'ERROR'").select(*SCREEN_COLUMNS), "text_unit_id", "stage1_status").join(units.select("text_unit_id").distinct(), "text_unit_id", "left_semi")
        parts.append(kept)
        todo = todo.join(kept.select("text_unit_id"), "text_unit_id", "left_anti")
    if features is not None:
        skipped = skipped_units(features).join(todo.select("text_unit_id"), "text_unit_id", "left_semi")
        parts.append(skipped)
        todo = todo.join(skipped.select("text_unit_id"), "text_unit_id", "left_anti")
    asked = cut(call_model(todo.select("text_unit_id", screening_prompt().alias("prompt")), system, "prompt", provider, retry, partitions))
    r = screening_reply(F.col("raw"))
    fresh = asked.withColumn("r", F.when(F.col("raw").isNotNull(), r)).select(
        "text_unit_id", F.coalesce("r.relevance", F.lit("uncertain")).alias("relevance"), "r.confidence_score", F.coalesce("r.reason", F.lit("")).alias("reason"),
        F.coalesce("r.status", F.lit("ERROR")).alias("stage1_status"), F.coalesce("call_error", F.when(F.coalesce("r.status", F.lit("ERROR")) == "ERROR", "no relevance in the reply"), F.lit("")).alias("stage1_error"),
    )
    for part in parts:
        fresh = fresh.unionByName(part)
    return fresh


def screening_failures(screened: DataFrame) -> DataFrame:
    """One record of every unit whose screening failed: when, where and why."""
    bad = screened.where("stage1_status = 'ERROR'")
    return bad.select(F.current_timestamp().alias("created_at"), F.lit("stage1").alias("stage"), "text_unit_id", F.when(F.col("stage1_error").contains(":"), F.substring_index("stage1_error", ":", 1)).otherwise("ParseError").alias("error_type"), F.col("stage1_error").alias("error"), F.col("reason").alias("raw_response"))


def one_screening(screening: DataFrame) -> DataFrame:
    """One row a unit: usable ones before errors, then the greatest score; relevance in lower case."""
    ranked = screening.select("text_unit_id", F.when(F.col("stage1_status") == "ERROR", 0).otherwise(1).alias("usable"), F.coalesce("confidence_score", F.lit(-1.0)).alias("score"), F.lower(F.trim("relevance")).alias("relevance"), "confidence_score")
    return last_by_id(ranked, "text_unit_id", "usable", "score").select("text_unit_id", "relevance", "confidence_score")


def route_units(units: DataFrame, features: DataFrame, screening: DataFrame) -> DataFrame:
    """Units with a keyword, or related or uncertain ones, with why: keyword, stage1_related, stage1_uncertain joined by +.

    features and screening are reduced to one row a unit first, so repeated rows don't multiply units.
    """
    words = features.groupBy("text_unit_id").agg(F.max(tolerant_bool(F.col("keyword_candidate"))).alias("keyword_candidate"), F.max("matched_terms").alias("matched_terms"))
    joined = units.join(words, "text_unit_id", "left").join(one_screening(screening), "text_unit_id", "left").na.fill(False, ["keyword_candidate"])
    relevance = F.coalesce("relevance", F.lit(""))
    why = F.concat_ws("+", F.when(F.col("keyword_candidate"), F.lit("keyword")), F.when(relevance.isin(*FORWARDED), F.concat(F.lit("stage1_"), relevance)))
    return joined.withColumn("relevance", relevance).withColumn("route_reason", why).where("route_reason <> ''").select(*units.columns, "keyword_candidate", "matched_terms", "relevance", "confidence_score", "route_reason")


def variant_units(method: str, units: DataFrame, features: DataFrame | None = None, screening: DataFrame | None = None) -> DataFrame:
    """The units of a robustness variant: ``keyword`` (with a keyword), ``llm_only`` (related or uncertain) or ``full_llm`` (all)."""
    if method == "full_llm":
        return units
    if method == "keyword":
        ids = features.where(tolerant_bool(F.col("keyword_candidate")))
    elif method == "llm_only":
        ids = one_screening(screening).where(F.col("relevance").isin(*FORWARDED))
    else:
        raise ValueError(method)
    return units.join(ids.select("text_unit_id").distinct(), "text_unit_id", "left_semi")


def head_units(units: DataFrame, n: int | None) -> DataFrame:
    """The first n units by id, or all."""
    return units if n is None else units.orderBy("text_unit_id").limit(n)


def complete_screening(units: DataFrame, screening: DataFrame) -> DataFrame:
    """One row: missing, surplus and repeated ids of a screening, and whether it is complete."""
    a = units.select("text_unit_id").distinct().withColumn("u", F.lit(1))
    b = screening.groupBy("text_unit_id").agg(F.count(F.lit(1)).alias("n"))
    j = a.join(b, "text_unit_id", "full_outer").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("u").isNull()).alias("surplus"), F.count_if(F.col("n") > 1).alias("repeated"))
    return j.withColumn("complete", (F.col("missing") == 0) & (F.col("surplus") == 0) & (F.col("repeated") == 0))
