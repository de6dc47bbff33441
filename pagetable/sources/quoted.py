"""Delimited text with line breaks inside quotes, read by many tasks a file.

Spark's `multiLine` reader gives a whole file to one task. Here lines are read in byte blocks. A line begins a record if
the quotes before it are even in number: the blocks' quotes are counted, summed up over the blocks of a file, and the
lines of a block are summed up within it. Lines of a record come together inside their block; what a record has in later
blocks is at most one piece a block, and is appended to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),  # only its order within a block counts
        "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2).alias("odd"),
    )


def _joined(pieces) -> F.Column:
    """The texts of an array of (place, text) in the order of their places."""
    return F.array_join(F.transform(F.sort_array(pieces), lambda p: p["value"]), "\n")


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): every record of the files as text, `first` for the first one of a file.

    Quotes are doubled inside cells, and cells that hold quotes are quoted, as `write_records` writes them. The lines move
    once, by block; a block fits a task by its size, as does the longest record.
    """
    lines = _lines(spark, path)
    ends = F.min_by(F.endswith("value", F.lit("\r")), "line")
    sums = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odds"), ends.alias("cr"))
    blocks = Window.partitionBy("file").orderBy("block")  # one row a block
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    odds = F.coalesce(F.sum("odds").over(earlier), F.lit(0))
    # as its first line ends, so do all lines of a file
    carried = sums.select("file", "block", odds.alias("carried"), F.first("cr").over(blocks).alias("cr"))

    inside = Window.partitionBy("file", "block").orderBy("line")
    quotes = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.join(carried, ["file", "block"]).withColumns(
        {
            "begins": ((quotes + F.col("carried")) % 2 == 0).cast("int"),
            "value": F.when(F.col("cr"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")),
        }
    )
    # 0: lines that belong to a record of an earlier block
    counted = begun.withColumn("rec", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = counted.groupBy("file", "block", "rec").agg(_joined(F.collect_list(F.struct("line", "value"))).alias("value"))

    last = pieces.groupBy("file", "block").agg(F.max("rec").alias("rec"))
    owner = F.last(F.when(F.col("rec") > 0, F.struct("block", "rec")), ignorenulls=True)
    owners = last.select("file", "block", owner.over(earlier).alias("o")).where("o is not null")  # one row a block
    tails = (
        pieces.where("rec = 0")
        .join(owners, ["file", "block"])
        .groupBy("file", F.col("o.block").alias("block"))
        .agg(_joined(F.collect_list(F.struct("block", "value"))).alias("tail"), F.max("o.rec").alias("last"))
    )
    # one row a block, which the last record of the block takes; the pieces lie by block already
    whole = pieces.where("rec > 0").join(tails, ["file", "block"], "left")
    text = F.concat_ws("\n", "value", F.when(F.col("rec") == F.col("last"), F.col("tail")))
    return whole.select("file", ((F.col("block") == 0) & (F.col("rec") == 1)).alias("first"), text.alias("record"))


def read_quoted(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Rows of delimited files with a header each, as Spark's `multiLine` reader gives them, whatever their size.

    A header with other names than the schema's is an error; empty lines are no records.
    """
    options = dict(sep=sep, quote='"', escape='"', multiLine="true")
    named = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema) + 1)])
    rows = quoted_records(spark, path).where(F.col("record") != "")
    names = F.from_csv("record", named.simpleString()[7:-1].replace(":", " "), options)
    cells = F.array(*[names[f.name] for f in named])
    wrong = ~cells.eqNullSafe(F.array(*[F.lit(n) for n in schema.names], F.lit(None).cast("string")))
    message = F.concat(F.lit("header does not match the schema: "), F.col("record"))
    is_row = F.when(~F.col("first"), F.lit(True)).when(wrong, F.raise_error(message).cast("boolean")).otherwise(F.lit(False))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return rows.where(is_row).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; only the listing is read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
