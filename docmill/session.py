"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def expose_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where it lies, if they don't get it otherwise (--py-files)."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data directory."""
    expose_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Only where neither is set (a local session in tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docmill-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


_CUTS: list[str] = []


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that this process has cut, once nothing reads them any more; says how many."""
    for path in _CUTS:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    n = len(_CUTS)
    _CUTS.clear()
    return n


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs no recomputation of what led to df, and a
    plan that uses df twice computes it once.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(wanted: str, *frames: DataFrame) -> str:
    """A column name based on wanted that none of the frames has (names are compared without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least two partitions a core, for work in Python that is heavy for the bytes it reads.

    A large table's scan has more partitions than that and isn't shuffled; a table of a few files is hashed by key.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)
