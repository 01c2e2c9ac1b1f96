"""Queries of the general data problems (as-of attributes, differences between copies) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.dates import lenient_date, lenient_year
from docmill.operators.asof import asof_valid
from docmill.operators.diff import table_diff
from docmill.session import read

DIFF_FIELDS = ("entity", "type", "status", "evidence")
_EPOCH_DAYS = "datediff({}, date'1970-01-01')"


def dictionary_versions(dictionary: DataFrame) -> DataFrame:
    """The versions of a standards dictionary on a time axis of days: base, dict_id, from, to, known.

    Rows without a readable start, and withdrawn rows without a readable end, are never in force and
    are left out. A version is known from the first day of its version year. An end counts as the first day
    without the version.
    """
    start, end = lenient_date(F.col("生效日期")), lenient_date(F.col("失效日期"))
    dated = dictionary.select(F.col("基础编号").alias("base"), "dict_id", F.col("版本年份").alias("version"), start.alias("start"), end.alias("end"), (F.trim("当前状态") == "废止").alias("withdrawn"))
    live = dated.where("start is not null and not (coalesce(withdrawn, false) and end is null)")
    return live.select(
        "base",
        "dict_id",
        "version",
        F.datediff("start", F.lit("1970-01-01").cast("date")).alias("from_day"),
        F.datediff("end", F.lit("1970-01-01").cast("date")).alias("to_day"),
        F.datediff(F.make_date("version", F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).alias("known_day"),
    )


def unit_years(units: DataFrame) -> DataFrame:
    """One row a unit: its year, from the id (code_year_order) where the field gives none."""
    own = units.groupBy("text_unit_id").agg(F.max(lenient_year(F.col("year"))).alias("y"))
    return own.select("text_unit_id", F.coalesce("y", lenient_year(F.element_at(F.split("text_unit_id", "_"), 2))).alias("y"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary version in force at the end of the unit's year, for each citation that has one."""
    cited = read(spark, d, "standard_citations").where("`基础编号` is not null and text_unit_id is not null")
    years = unit_years(read(spark, d, "text_units").where("text_unit_id is not null"))
    events = cited.join(years, "text_unit_id").where("y is not null").select(
        F.col("基础编号").alias("base"), "citation_id", F.datediff(F.make_date("y", F.lit(12), F.lit(31)), F.lit("1970-01-01").cast("date")).alias("day")
    )
    found = asof_valid(events, dictionary_versions(read(spark, d, "gb_dict")), "base", "citation_id", "day", "dict_id", "from_day", "to_day", "known_day", ["version"])
    return found.distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that only one of the two copies has, and fields that differ."""
    main, copy = read(spark, d, "stage2_result"), read(spark, d, "stage2_result_copy")
    return table_diff(main, copy, ["text_unit_id", "item_no"], DIFF_FIELDS, "extracted_at", "synced_at").select("text_unit_id", "item_no", "diff")


def queries() -> dict:
    return {"p3_found": p3_found, "p6_found": p6_found}


def _sql_date(column: str) -> str:
    s = f"trim(translate({column}, '０１２３４５６７８９', '0123456789'))"
    p = r"^(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
    part = lambda i, w: f"lpad(regexp_extract({s}, '{p}', {i}), {w}, '0')"
    solid = f"concat_ws('-', substr({s}, 1, 4), substr({s}, 5, 2), substr({s}, 7, 2))"
    return f"case when regexp_matches({s}, '^[0-9]{{8}}$') then try_cast({solid} as date) when regexp_matches({s}, '{p}') then try_cast(concat_ws('-', {part(1, 4)}, {part(2, 2)}, {part(3, 2)}) as date) end"


def _sql_year(column: str) -> str:
    s = f"trim(translate({column}, '０１２３４５６７８９', '0123456789'))"
    four, two = f"regexp_extract({s}, '^([0-9]{{4}})([^0-9]|$)', 1)", f"regexp_extract({s}, '^([0-9]{{2}})(\\.0)?\\s*年?度?$', 1)"
    return f"case when {four} <> '' then cast({four} as int) when {two} <> '' then cast({two} as int) + case when cast({two} as int) > 50 then 1900 else 2000 end end"


def oracle_sql() -> dict[str, str]:
    value = lambda f: f"coalesce(trim({f}, ' '), '')"
    side = lambda t, at: "select text_unit_id, item_no, " + ", ".join(f"{value(f)} as {f}" for f in DIFF_FIELDS) + f" from {t} qualify row_number() over (partition by text_unit_id, item_no order by {at} desc) = 1"
    differs = " union all ".join(f"select a.text_unit_id, a.item_no, '{f}' as diff from a join b on a.text_unit_id is not distinct from b.text_unit_id and a.item_no is not distinct from b.item_no where a.{f} <> b.{f}" for f in DIFF_FIELDS)
    lacks = lambda x, y, kind: f"select {x}.text_unit_id, {x}.item_no, '{kind}' as diff from {x} where not exists (select 1 from {y} where {x}.text_unit_id is not distinct from {y}.text_unit_id and {x}.item_no is not distinct from {y}.item_no)"
    return {
        "p3_found": f"""
            with d as (select "基础编号" as base, dict_id, "版本年份" as version, "当前状态" as state, {_sql_date('"生效日期"')} as s, {_sql_date('"失效日期"')} as e from gb_dict),
            u as (select text_unit_id, coalesce(max({_sql_year("year")}), cast(split_part(text_unit_id, '_', 2) as int)) as y from text_units group by text_unit_id)
            select distinct c.citation_id, d.dict_id from standard_citations c join u using (text_unit_id) join d on d.base = c."基础编号"
            where d.s <= make_date(u.y, 12, 31) and (d.version is null or d.version <= u.y) and (d.e is null or d.e > make_date(u.y, 12, 31)) and not (coalesce(trim(d.state) = '废止', false) and d.e is null)
            qualify row_number() over (partition by c.citation_id order by d.s desc, d.version desc nulls last, d.dict_id) = 1""",
        "p6_found": f"with a as ({side('stage2_result', 'extracted_at')}), b as ({side('stage2_result_copy', 'synced_at')}) {differs} union all {lacks('a', 'b', 'only_main')} union all {lacks('b', 'a', 'only_copy')}",
    }
