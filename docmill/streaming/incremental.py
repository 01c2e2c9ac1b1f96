"""Incremental processing of units as they arrive: each micro-batch is anti-joined with what is done, and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.extraction import pending_units
from docmill.sources.tables import exists


def unit_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files of units."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_incremental(units: DataFrame, results: str, checkpoint: str, process: Callable[[DataFrame, DataFrame | None], DataFrame], buckets: int = 64) -> StreamingQuery:
    """Processes each micro-batch of new units once and adds a folder batch=N of ``results`` for it; ends when all files are read.

    process(units, done) gives result rows; done is what earlier batches gave for units of this batch's buckets. Results lie in buckets of the unit's
    id, and a batch reads only the buckets that its units fall into. A batch that is run again after a failure replaces its own
    folder, so half-written results never count, and every unit is written once.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        mine = F.pmod(F.xxhash64("text_unit_id"), F.lit(buckets)).cast("int")
        df = df.persist()
        try:
            done = None
            if exists(spark, results):
                touched = [r["b"] for r in df.select(mine.alias("b")).distinct().collect()]  # at most `buckets` rows
                done = spark.read.option("basePath", results).parquet(results).where((F.col("batch") < number) & F.col("bucket").isin(touched)).drop("batch", "bucket")
            process(pending_units(df, done), done).withColumn("bucket", mine).write.mode("overwrite").partitionBy("bucket").parquet(f"{results}/batch={number}")
        finally:
            df.unpersist()

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
