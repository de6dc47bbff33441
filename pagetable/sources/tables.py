"""Frontier, record and run tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from pagetable.functions.http import is_text
from pagetable.functions.urls import mirror_path, url_host
from pagetable.functions.values import format_accessed, size_to_bytes
from pagetable.operators.scan import number_rows
from pagetable.plans.library import Library
from pagetable.schemas import FRONTIER, RUNS
from pagetable.sources.quoted import largest_file, read_quoted


def records_schema(lib: Library) -> T.StructType:
    """Columns of an extracted table on disk: all text."""
    names = ["dateaccessed", "url", *lib.csv_cols]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def empty_records(spark: SparkSession, lib: Library) -> DataFrame:
    return spark.createDataFrame([], records_schema(lib))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False


def _split_bytes(spark: SparkSession) -> int:
    size = size_to_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes").upper().removesuffix("B"))
    return size if size > 0 else 1 << 27


def read_frontier(spark: SparkSession, path: str, statuses=None, sep: str = ";") -> DataFrame:
    """Saved frontier in queue order (`seq`), optionally only some statuses; an empty table when there is none.

    A file without `seq` keeps the order of its lines.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], FRONTIER)
    # numbers may be written as 200 or 200.0
    loose = T.StructType([T.StructField(f.name, T.StringType()) for f in FRONTIER])
    # a quoted empty text would come back as NULL: it is read as a mark
    raw = spark.read.schema(loose).options(sep=sep, header=True, quote='"', escape='"', emptyValue="\u0001").csv(path)
    cells = [
        (
            F.when(F.col(f.name) == "\u0001", F.lit("")).otherwise(F.col(f.name))
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name).try_cast("double").cast(f.dataType)
        ).alias(f.name)
        for f in FRONTIER
    ]
    typed = raw.select(*cells)
    if typed.where("seq is not null").isEmpty():
        lines = raw.select(
            *cells,
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
        typed = number_rows(lines.drop("seq"), ["_file", "_block", "_line"], "seq").select(*FRONTIER.names)
    return typed if statuses is None else typed.where(F.col("status").isin(list(statuses)))


def write_frontier(frontier: DataFrame, path: str, sep: str = ";") -> None:
    """One line per queued URL, in queue order where there is one."""
    names = [f for f in FRONTIER.names if f in frontier.columns]
    rows = frontier.select(*names)
    if "seq" in names:
        rows = rows.orderBy("seq")
    # NULL is nothing between separators, an empty text is ""
    rows.write.mode("overwrite").options(sep=sep, header=True, escape='"').csv(path)


def read_records(spark: SparkSession, path: str, lib: Library, sep: str = ";", by_block: bool | None = None) -> DataFrame:
    """Saved records; an empty table when there are none.

    A cell may hold line breaks. Where a file is larger than 64 splits, files are read in blocks (`quoted`), which asks that
    cells with quotes are quoted, as `write_records` does; otherwise, or with `by_block=False`, by one task each. Blocks
    cost much more CPU (50 MB: 12 s on four cores, 1.8 s by one task), so they pay only where one task has gigabytes.
    """
    if not _exists(spark, path):
        return empty_records(spark, lib)
    if by_block is None:
        by_block = largest_file(spark, path) > 64 * _split_bytes(spark)
    if by_block:
        return read_quoted(spark, path, records_schema(lib), sep)
    options = dict(sep=sep, header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)
    return spark.read.schema(records_schema(lib)).options(**options).csv(path)


def csv_view(records: DataFrame) -> DataFrame:
    """Text form of every cell: `dd/MM/yyyy HH:mm:ss` times, lists as JSON."""
    out = []
    for f in records.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = format_accessed(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.cast("string").alias(f.name))
    return records.select(*out)


def write_records(records: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    view = csv_view(records)
    view.write.mode(mode).options(sep=sep, header=True, quoteAll=True, escape='"', emptyValue="").csv(path)


def mirror_plan(pages: DataFrame, root: str = "", content_type=None) -> DataFrame:
    """Page columns plus `host`, `mirror_path` and `as_text`."""
    kind = F.lit(True) if content_type is None else is_text(content_type)
    return pages.withColumns(
        {"host": url_host("url"), "mirror_path": mirror_path(root, "url"), "as_text": kind}
    )


def mirror_pages(pages: DataFrame, root: str, content_type=None, buckets: int = 256) -> None:
    """Store pages below `root`; `mirror_path` is each page's place in a mirror, `as_text` whether it is text.

    Folders are hash buckets of hosts, so their number does not grow with the hosts; `host` stays a column and
    files are sorted by it. Range partitions over (bucket, host, url hash): a large host fills several tasks.
    """
    planned = mirror_plan(pages, "", content_type).withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(buckets)))
    dealt = planned.repartitionByRange("bucket", "host", F.xxhash64("url")).sortWithinPartitions("bucket", "host", "mirror_path")
    dealt.write.mode("append").partitionBy("bucket").parquet(root)


def log_run(spark: SparkSession, run: dict, path: str) -> None:
    """Append one run to the history."""
    spark.createDataFrame([tuple(run.get(n) for n in RUNS.names)], RUNS).write.mode("append").parquet(path)


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """Newest runs first."""
    return runs.orderBy(F.desc("started"), F.desc("run_id")).limit(n)
