"""Ordered-line operators as windows over exploded lines: header neighbourhoods, table blocks and protected context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.lines import has_term, is_company_header, is_dot_leader, is_page_number, is_report_header, table_score
from docmill.functions.norm import compact, strip

CONTEXT = 2
SPLIT_BLOCK, SPLIT_WINDOW = 12, 6
BLOCK_LINES, DENSE_LINES, DENSE_SCORE, TABLE_LIKE = 4, 3, 0.85, 0.6


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ln (from 0) and line of every line of a text; null texts have none, an empty text has one empty line."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("ln", "line"))


def droppable_lines(lines: DataFrame, keys: list[str], year: str | None = None) -> DataFrame:
    """lines with is_header, near_header and dropped: blank lines, contents, report headers, page numbers, and company
    names within two lines of a report header."""
    y = F.col(year) if year else None
    flagged = lines.withColumn("is_header", is_report_header(F.col("line"), y))
    order = W.partitionBy(*keys).orderBy("ln")
    near = lambda a, b: F.coalesce(F.max("is_header").over(order.rowsBetween(a, b)), F.lit(False))
    s = strip(F.col("line"))
    out = flagged.withColumn("near_header", near(-CONTEXT, -1) | near(1, CONTEXT))
    return out.withColumn("dropped", (s == "") | s.isin("目", "录", "目录") | is_dot_leader(F.col("line")) | F.col("is_header") | is_page_number(F.col("line")) | (is_company_header(F.col("line")) & F.col("near_header")))


def table_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first_ln, last_ln, n and mean_score of every table-like run: lines scoring 0.6 or more without a blank one
    between, at least four of them, or three with a mean of 0.85."""
    order = W.partitionBy(*keys).orderBy("ln")
    scored = lines.withColumn("score", table_score(F.col("line"))).withColumn("like", F.col("score") >= TABLE_LIKE)
    islands = scored.withColumn("island", F.sum((~F.col("like")).cast("int")).over(order)).where("like")
    runs = islands.groupBy(*keys, "island").agg(F.min("ln").alias("first_ln"), F.max("ln").alias("last_ln"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return runs.where((F.col("n") >= BLOCK_LINES) | ((F.col("n") >= DENSE_LINES) & (F.col("mean_score") >= DENSE_SCORE))).drop("island")


def anchored_context(lines: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """lines with anchored and protected: lines with a term, or in the shortest window of up to SPLIT_WINDOW lines of a table over whose
    cells a term is split, and up to two lines on either side until a blank one. A table of up to SPLIT_BLOCK lines that holds
    a term over its cells is protected as a whole."""
    order = W.partitionBy(*keys).orderBy("ln")
    blocks = table_blocks(lines, keys).select(*keys, F.col("first_ln").alias("ln"), "last_ln", F.col("n").alias("block_n"))
    flagged = lines.join(blocks, [*keys, "ln"], "left").withColumn("blank", strip(F.col("line")) == "").withColumn("own", has_term(F.col("line"), terms))
    # Every line of a block knows the block it is in.
    last = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    flagged = flagged.withColumn("until", last("last_ln")).withColumn("size", last("block_n")).withColumn("from_ln", last(F.when(F.col("last_ln").isNotNull(), F.col("ln"))))
    inside = F.coalesce(F.col("ln") <= F.col("until"), F.lit(False))
    flagged = flagged.withColumn("block", F.when(inside, F.col("from_ln")))
    cells = W.partitionBy(*keys, "block").orderBy("ln")
    joined = F.array_join(F.collect_list(compact(F.col("line"))).over(W.partitionBy(*keys, "block").orderBy("ln").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "")
    flagged = flagged.withColumn("holds", F.when(F.col("block").isNotNull(), has_term(joined, terms)).otherwise(F.lit(False)))
    reach = F.lit(None).cast("int")
    for k in reversed(range(SPLIT_WINDOW)):
        window = F.array_join(F.collect_list(strip(F.col("line"))).over(cells.rowsBetween(0, k)), "")
        reach = F.when(has_term(window, terms), F.lit(k)).otherwise(reach)
    flagged = flagged.withColumn("reach", F.when(F.col("holds") & (F.col("size") > SPLIT_BLOCK), reach))
    split = F.lit(False)
    for back in range(SPLIT_WINDOW):
        split = split | F.coalesce(F.lag("reach", back).over(cells) >= back, F.lit(False))
    flagged = flagged.withColumn("seed", F.col("own") | (F.col("block").isNotNull() & split))
    near = F.lit(False)
    for step in (F.lag, F.lead):
        at = lambda name, k, default, step=step: F.coalesce(step(name, k).over(order), F.lit(default))
        # A neighbour two lines away counts only if the line between isn't blank.
        near = near | at("seed", 1, False) | (at("seed", 2, False) & ~at("blank", 1, True))
    whole = F.col("holds") & (F.col("size") <= SPLIT_BLOCK)
    out = flagged.withColumn("protected", F.col("seed") | whole | (~F.col("blank") & near))
    return out.select(*lines.columns, F.col("own").alias("anchored"), "protected")


def noise_scores(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and the mean table score of a text's non-blank lines, rounded to four places; 0 if it has none."""
    scored = lines_of(df, keys, text).where(strip(F.col("line")) != "").groupBy(*keys).agg(F.round(F.avg(table_score(F.col("line"))), 4).alias("noise_score"))
    return df.select(*keys).distinct().join(scored, keys, "left").na.fill(0.0, ["noise_score"])
