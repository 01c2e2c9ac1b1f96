"""Tables at the border: CSV with a byte order mark, JSON lines, Parquet inside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SchemaError(ValueError):
    """Columns are missing."""


def require(df: DataFrame, columns: Iterable[str], source: str) -> DataFrame:
    """df, if it has the columns; further ones are allowed."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{source} lacks {', '.join(missing)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV of a known schema (never inferred); an empty table if the path doesn't exist. Line ends in quotes are kept."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True, encoding="UTF-8", enforceSchema=True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = True) -> None:
    """A folder of CSV files with a header, minimal quoting and doubled quotes; arrays joined by ;. With ``mark`` every file begins with a
    byte order mark, as spreadsheets want."""
    flat = df.select(*[F.array_join(F.col(f"`{n}`").cast("array<string>"), ";").alias(n) if t.startswith("array") else F.col(f"`{n}`") for n, t in df.dtypes])
    if mark and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    flat.write.mode(mode).csv(path, header=True, escape='"', emptyValue="", encoding="UTF-8")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a schema; blank and malformed lines are left out, a path that doesn't exist is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines; the committer makes a failed task leave nothing."""
    df.write.mode("append").json(path)


def queued_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty text_unit_id of a queue of failures."""
    return read_json_lines(spark, path, "text_unit_id string").where("text_unit_id <> ''").distinct()
