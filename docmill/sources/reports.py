"""Report files and keyword files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "utf-8-sig", "gb18030")


def decode_bytes(content: bytes | None) -> str | None:
    """Text in the first encoding that fits; UTF-8 without what doesn't fit, if none does."""
    if content is None:
        return None
    for name in ENCODINGS:
        try:
            return bytes(content).decode(name)
        except UnicodeDecodeError:
            continue
    return bytes(content).decode("utf-8", "ignore")


def decoded(content: Column) -> Column:
    """decode_bytes as a Column: Spark's decode doesn't know GB18030."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(decode_bytes)

    return F.pandas_udf(run, "string")(content)


def file_parts(name: Column) -> Column:
    """struct(stock_code, company_name, year) of code_year_name… or code_name_year…; null for other names."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    is_year = lambda c: F.coalesce(c.rlike(r"^\d{4}$"), F.lit(False))
    made = lambda company, year: F.struct(at(1).alias("stock_code"), company.alias("company_name"), year.alias("year"))
    return F.when(F.size(parts) >= 3, F.when(is_year(at(2)), made(at(3), at(2))).when(is_year(at(3)), made(at(2), at(3))))


def report_dir(spark: SparkSession, root: str, year: str) -> str:
    """The one folder of a year, named year_…; an error if there is none, or more than one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{year}_*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = [f.getPath().toString() for f in found if f.isDirectory()]
    if len(folders) != 1:
        raise FileNotFoundError(f"{len(folders)} folders {root}/{year}_*")
    return folders[0]


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """stock_code, company_name, year, source_file and text of the .txt files of a folder whose names can be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,TXT}").load(path)
    named = files.withColumn("source_file", F.url_decode(F.element_at(F.split("path", "/"), -1))).withColumn("m", file_parts(F.col("source_file")))
    return named.where("m is not null").select("m.*", "source_file", decoded(F.col("content")).alias("text"))


def list_reports(spark: SparkSession, root: str) -> DataFrame:
    """path, source_file, stock_code, company_name and year of all .txt reports below a folder; texts aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,TXT}").option("recursiveFileLookup", "true").load(root).select("path")
    named = files.withColumn("source_file", F.url_decode(F.element_at(F.split("path", "/"), -1))).withColumn("m", file_parts(F.col("source_file")))
    return named.where("m is not null").select("path", "source_file", "m.*")


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """Terms of a file with one a line, longest first; blank lines and lines with # are left out. An error if none is left.

    A keyword file is edited by hand, so its size is bounded.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("t")).where("t <> '' and not startswith(t, '#')").distinct()
    terms = [r["t"] for r in lines.orderBy(F.desc(F.length("t")), "t").limit(100_001).collect()]
    if not 0 < len(terms) <= 100_000:
        raise ValueError(f"no terms, or too many, in {path}")
    return terms
