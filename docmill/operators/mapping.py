"""Mapping standards to international ones as of the end of a report's year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.dates import lenient_date
from docmill.functions.norm import full_year, optional, report_year, standard_code

# Names that the dictionary's columns may have.
CODE = ("标准号", "标准编号", "国家标准编号")
INTERNATIONAL = ("国际标准编号", "国际标准", "采用国际标准编号")
ADOPTION = ("采标类型", "采标情况", "采用程度")
EFFECTIVE, EXPIRY, STATE, QUALITY = ("生效日期", "实施日期"), ("失效日期",), ("当前状态", "状态"), ("时间数据质量",)
LEGACY, NOT_FOUND, FOUND = "LEGACY_ONLY_NO_TEMPORAL_METADATA", "未找到采标信息", "已找到采标信息"


def pick(df: DataFrame, names: tuple[str, ...], optional_column: bool = False) -> str | None:
    """The first of the names that df has; an error, or null if optional, if it has none."""
    for n in names:
        if n in df.columns:
            return n
    if optional_column:
        return None
    raise ValueError(f"one of the columns {names} is required")


def versions(dictionary: DataFrame, exact: bool = True) -> DataFrame:
    """base, version, code, international, adoption, effective, expiry, state and quality of every dictionary row with a base."""
    code = F.col(pick(dictionary, CODE))
    get = lambda names: optional(F.col(c)) if (c := pick(dictionary, names, True)) else F.lit(None).cast("string")
    parsed = standard_code(code, exact)
    rows = dictionary.select(
        parsed["base"].alias("base"), full_year(parsed["version"]).alias("version"), code.cast("string").alias("code"), optional(F.col(pick(dictionary, INTERNATIONAL))).alias("international"),
        optional(F.col(pick(dictionary, ADOPTION))).alias("adoption"), lenient_date(get(EFFECTIVE), strict=True).alias("effective"), lenient_date(get(EXPIRY), strict=True).alias("expiry"), get(STATE).alias("state"), get(QUALITY).alias("quality"),
    )
    return rows.where("base is not null")


def asof_mapping(wanted: DataFrame, entity: str, year: str, dictionary: DataFrame, exact: bool = True) -> DataFrame:
    """entity, year (both as given, distinct) with the code, international and adoption of the version that applies.

    An entity with a version takes that version, unless it, or its start, is after the report's year; its end isn't looked at.
    One without takes, of the versions that are in force at the end of the year, the one with the latest start (or first day of
    its version year), then version year, then code; without a readable year, the newest version. Entities are made
    distinct before the dictionary is joined by base, so a frequent entity costs no more than a rare one.
    """
    parsed = standard_code(F.col("entity"), exact)
    probe = wanted.select(F.col(entity).alias("entity"), F.col(year).cast("string").alias("year")).where("entity is not null").distinct()
    probe = probe.withColumn("p", parsed).withColumn("y", report_year(F.col("year"), exact)).select("entity", "year", "y", F.col("p.base").alias("base"), full_year(F.col("p.version")).alias("asked"), F.col("p.version").isNotNull().alias("versioned"))
    d = versions(dictionary, exact)
    cutoff = F.make_date("y", F.lit(12), F.lit(31))
    started = F.coalesce(F.col("effective"), F.when(F.col("version") > 0, F.make_date("version", F.lit(1), F.lit(1))))
    no_year = F.col("y").isNull()
    explicit = F.col("versioned") & (F.col("version") == F.col("asked"))
    in_time = no_year | ((F.col("version") <= F.col("y")) & F.coalesce(F.col("effective") <= cutoff, F.lit(True)))
    legacy = F.coalesce(F.col("quality").contains(LEGACY), F.lit(False))
    in_force = F.col("effective").isNull() | ((F.col("effective") <= cutoff) & F.coalesce(F.col("expiry") > cutoff, F.lit(True)) & ~(F.col("expiry").isNull() & F.coalesce(F.col("state") == "废止", F.lit(False))))
    open_ = ~F.col("versioned") & (no_year | ((F.col("version") > 0) & (F.col("version") <= F.col("y")) & ~legacy & in_force))
    # Of an explicit version the best row is chosen first and then checked against the year.
    rank = F.when(~F.col("versioned") & no_year, F.struct(F.lit(None).cast("date").alias("s"), F.col("version").alias("v"), F.col("code").alias("c"))).otherwise(F.struct(started.alias("s"), F.col("version").alias("v"), F.col("code").alias("c")))
    joined = probe.join(d, "base").where(explicit | open_)
    best = joined.groupBy("entity", "year").agg(F.max_by(F.struct("code", "international", "adoption", in_time.alias("in_time"), "versioned"), rank).alias("m"))
    return best.where("m.in_time or not m.versioned").select("entity", "year", "m.code", "m.international", "m.adoption")


def mapped_entities(results: DataFrame, dictionary: DataFrame, exact: bool = True) -> DataFrame:
    """results with 国际标准, 采标情况 and output: TYPE_B rows from the dictionary, others with their own
    entity and type; output is 1 for adopted TYPE_A and TYPE_C rows, and for adopted TYPE_B rows with an international standard."""
    found = asof_mapping(results.where("type = 'TYPE_B'"), "entity", "year", dictionary, exact).select(F.col("entity").alias("m_entity"), F.col("year").alias("m_year"), "international", "adoption", "code")
    # Only TYPE_B rows take part in the join, and null years meet null years.
    key = F.when(F.col("type") == "TYPE_B", F.col("entity"))
    joined = results.withColumn("m_key", key).join(found, (F.col("m_key") == F.col("m_entity")) & F.col("year").cast("string").eqNullSafe(F.col("m_year")), "left")
    is_b, adopted = F.coalesce(F.col("type") == "TYPE_B", F.lit(False)), F.coalesce(F.col("status") == "ADOPTED", F.lit(False))
    hit = F.col("international").isNotNull()
    output = F.when(is_b, hit & adopted).when(F.col("type").isin("TYPE_A", "TYPE_C"), adopted).otherwise(F.lit(False))
    standard = F.when(is_b, F.col("international")).otherwise(F.col("entity"))
    adoption = F.when(is_b, F.when(hit, F.coalesce("adoption", F.lit(FOUND))).otherwise(NOT_FOUND)).otherwise(F.col("type"))
    return joined.select(*results.columns, standard.alias("国际标准"), adoption.alias("采标情况"), output.cast("int").alias("output"))
