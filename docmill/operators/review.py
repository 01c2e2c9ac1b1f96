"""Sampling, manual review and validation of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.norm import stock_code
from docmill.operators.extraction import completed_ids
from docmill.operators.replies import STATUSES, TYPES

RESULT_FIELDS = ("entity", "type", "status", "evidence")
REVIEW_COLUMNS = ("text_unit_id", *RESULT_FIELDS)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group in the order of a hash of seed, group and key; all rows for 0. The draw doesn't depend on the partitioning.

    Rows that can't be among the n of their group are dropped within each partition before the shuffle.
    """
    if n == 0:
        return df
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(key).cast("string")))
    marked = df.withColumn("_rank", rank)
    near = W.partitionBy(group, "_part").orderBy("_rank", key)
    far = W.partitionBy(group).orderBy("_rank", key)
    first = marked.withColumn("_part", F.pmod(F.xxhash64("_rank"), F.lit(64))).withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= n)
    return first.withColumn("_n", F.row_number().over(far)).where(F.col("_n") <= n).drop("_n", "_rank", "_part")


def sample_reports(reports: DataFrame, n: int, codes: str | None = None, seed: int = 42) -> DataFrame:
    """n report files of each year, of the given stock codes only if there are any; the draw goes by the file's name."""
    return sample_per_group(with_codes(reports, codes), "year", "source_file", n, seed)


def length_summary(df: DataFrame, text: str, short: int = 1000) -> DataFrame:
    """One row: texts, those under ``short``, and the median, least and greatest length."""
    n = F.char_length(text)
    return df.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(n < short).alias("n_short"), F.median(n).alias("median_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def with_codes(df: DataFrame, codes: str | None) -> DataFrame:
    """Rows whose stock code is in a list separated by commas or spaces; all without a list."""
    wanted = [c for c in (codes or "").replace(",", " ").split() if c]
    return df if not wanted else df.where(stock_code(F.col("stock_code")).isin([c.zfill(6) if c.isdigit() and len(c) <= 6 else c for c in wanted]))


def review_errors(review: DataFrame) -> DataFrame:
    """The review's rows that can't be used, with a problem each: missing values and unknown types or statuses."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    problems = F.array_compact(F.array(*[F.when(blank(c), F.lit(f"{c} is missing")) for c in REVIEW_COLUMNS], F.when(~blank("type") & ~F.col("type").isin(*TYPES), F.lit("unknown type")), F.when(~blank("status") & ~F.col("status").isin(*STATUSES), F.lit("unknown status"))))
    return review.select("*", F.explode(problems).alias("problem"))


def apply_review(results: DataFrame, review: DataFrame) -> DataFrame:
    """Results with reviewed rows: ERROR rows of reviewed units are removed, filled-in review rows are added."""
    filled = review.where("trim(coalesce(entity, '')) <> ''")
    ids = filled.select("text_unit_id").distinct()
    is_error = F.coalesce(F.upper(F.trim("entity")) == "ERROR", F.lit(False))
    kept = results.where(~is_error).unionByName(results.where(is_error).join(ids, "text_unit_id", "left_anti"))
    return kept.unionByName(filled.select(*[c for c in results.columns if c in filled.columns]), allowMissingColumns=True)


def unit_digests(results: DataFrame) -> DataFrame:
    """text_unit_id and a digest of its rows' contents, whatever their order."""
    row = F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in RESULT_FIELDS])
    other = F.xxhash64(F.lit(7), *[F.coalesce(F.col(c), F.lit("")) for c in RESULT_FIELDS])
    # Additive, so that no unit's rows are gathered.
    return results.groupBy("text_unit_id").agg(F.bit_xor(row).alias("x"), F.sum(other.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.count(F.lit(1)).alias("n")).select("text_unit_id", F.concat_ws("-", "x", "s", "n").alias("digest"))


def recovery_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: units that were lost, came new, or changed their rows between two runs, and surplus repeated rows of the second."""
    a, b = completed_ids(before), completed_ids(after)
    ids = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "text_unit_id", "full_outer").agg(F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNull()).alias("new"))
    x, y = unit_digests(before.join(a, "text_unit_id", "left_semi")), unit_digests(after.join(b, "text_unit_id", "left_semi"))
    changed = x.join(y.withColumnRenamed("digest", "d2"), "text_unit_id").agg(F.count_if(F.col("digest") != F.col("d2")).alias("changed"))
    repeated = duplicate_rows(after).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_rows"))
    return ids.join(F.broadcast(changed), F.lit(True)).join(F.broadcast(repeated), F.lit(True))  # one row each


def recovery_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """text_unit_id and what became of it between two runs: lost, new or changed; unchanged units have no row."""
    a, b = completed_ids(before), completed_ids(after)
    x, y = unit_digests(before.join(a, "text_unit_id", "left_semi")), unit_digests(after.join(b, "text_unit_id", "left_semi")).withColumnRenamed("digest", "d2")
    kind = F.when(F.col("d2").isNull(), "lost").when(F.col("digest").isNull(), "new").when(F.col("digest") != F.col("d2"), "changed")
    return x.join(y, "text_unit_id", "full_outer").select("text_unit_id", kind.alias("kind")).where("kind is not null")


def duplicate_rows(results: DataFrame) -> DataFrame:
    """Contents that stand more than once in a unit, with how often."""
    keys = ["text_unit_id", "entity", "type", "evidence"]
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
