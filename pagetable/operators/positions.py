"""Fetching few rows of a large Parquet table by file and row number, without moving the others."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetable.operators.scan import number_rows
from pagetable.plans.checkpoints import new_folder, through_table

STEP = 500_000  # rows fetched at a time: their positions (three numbers each, some 30 MB) are broadcast

_ROWWISE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def has_positions(df: DataFrame) -> bool:
    """Whether every row of `df` stands for one row of a Parquet file: a scan below projections and filters only.

    Spark names a position also above joins and duplicates' removal, where it need not be the same at the next reading.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _ROWWISE:
        if node.children().isEmpty():
            try:
                return "_metadata" not in df.columns and bool(df.select("_metadata.row_index").columns)
            except Exception as error:  # other formats have files, but no row numbers
                if type(error).__name__ != "AnalysisException":
                    raise
                return False
        node = node.children().head()
    return False


def file_of() -> Column:
    return F.col("_metadata.file_path")


def row_of() -> Column:
    return F.col("_metadata.row_index")


def fetch(df: DataFrame, wanted: DataFrame, key: str, file: str, row: str, step: int = STEP) -> Iterator[DataFrame]:
    """The rows of `df` at the places of `wanted` (`key`, `file`, `row`), in steps of at most `step` places.

    Each step reads the files between its first and last place only, and meets them with its own places, which are
    counted and therefore broadcast: no row of `df` is shuffled at any number of places. Empty: one step without rows.
    A file is told by a 64-bit hash, and so is the row's `key`, which has to agree as well.
    """
    counted = wanted.agg(F.count("*").alias("n"), F.min(file).alias("lo"), F.max(file).alias("hi")).first()
    if counted["n"] > step:
        numbered = number_rows(wanted.select(key, file, row), [file, row], "_n")
        placed = numbered.withColumn("_step", F.floor(F.col("_n") / step).cast("long"))
        wanted = through_table(placed, new_folder(df.sparkSession, "places"))
        parts = wanted.groupBy("_step").agg(F.min(file).alias("lo"), F.max(file).alias("hi")).orderBy("_step").collect()
        steps = [(wanted.where(F.col("_step") == p["_step"]), p["lo"], p["hi"]) for p in parts]
    else:
        steps = [(wanted, counted["lo"], counted["hi"])]
    for places, lo, hi in steps:
        near = df.where(file_of().between(F.lit(lo), F.lit(hi)))
        named = near.select(*df.columns, F.xxhash64(file_of()).alias("_f"), row_of().alias("_r"), F.xxhash64(key).alias("_k"))
        met = places.select(F.xxhash64(file).alias("_f"), F.col(row).alias("_r"), F.xxhash64(key).alias("_k"))
        yield named.join(F.broadcast(met), ["_f", "_r", "_k"], "left_semi").select(*df.columns)
