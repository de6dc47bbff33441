"""Cutting lineage through tables in the shared work folder, and removing them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("pagetable_run", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir`, which all executors share. It must be set."""
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return current


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of the open run, or else below the work folder."""
    base = _run.get() or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str):
    """Until it closes, all intermediate tables go below one folder. `drop_folder` removes it when its results are used."""
    path = new_folder(spark, name)
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a run's folder, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def through_table(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and read back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write in buckets of `key`, sorted, and read back: joins on the key then leave these rows where they are."""
    spark = df.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"pagetable_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: files at a stated path stay, and the plan knows their buckets
    return table
