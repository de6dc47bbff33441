"""Reading captured pages and seed URLs, at rest or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetable.operators.scan import number_rows
from pagetable.schemas import PAGES


def read_pages(spark: SparkSession, path: str, format: str = "parquet", tasks: int | None = None) -> DataFrame:
    """A table of captured pages.

    `format` is any Spark table format, or 'files': a folder (or glob) of saved pages, one page per
    file, whose url is the file's location. `tasks` deals the pages out to that many tasks, for a small
    table in a few large row groups; without it the table's splits are the tasks and nothing is shuffled.
    """
    if format == "files":
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    pages = spark.read.format(format).load(path)
    return pages.repartition(tasks) if tasks else pages


def read_seeds(spark: SparkSession, source) -> DataFrame:
    """(seq, url): URLs of a text file (one per line), one URL, or a list; repeats keep their first place."""
    if isinstance(source, str) and not source.startswith(("http:", "https:")):
        lines = spark.read.text(source).select(
            F.col("value").alias("url"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
        # a large file is read in blocks, whose order in the file is part of the line's place
        rows = number_rows(lines.where("url <> ''"), ["_file", "_block", "_line"], "seq").select("seq", "url")
    else:
        urls = [source] if isinstance(source, str) else list(source)
        rows = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    return rows.groupBy("url").agg(F.min("seq").alias("seq")).select("seq", "url")


def stream_pages(
    spark: SparkSession, path: str, schema: T.StructType = PAGES, format: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """Pages arriving as files in a folder."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
