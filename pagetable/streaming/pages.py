"""The batch operators on a stream of page captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagetable.functions.values import content_hash
from pagetable.operators.runlog import progress_windows
from pagetable.plans.crawl import gate_captures
from pagetable.plans.extraction import extract
from pagetable.plans.library import Library
from pagetable.streaming.log import BatchLog, KeyRuns


def stream_extract(page_stream: DataFrame, lib: Library, accessed_at=None, **options) -> DataFrame:
    """Continuous `extract`: stateless, append mode."""
    return extract(page_stream, lib, accessed_at, **options)


DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedup(page_stream: DataFrame, key: str = "hash", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First capture per key. With `event_time`, state is bounded and copies further apart than `delay` pass.

    Without it every key is remembered: the session's state store is set to the one that keeps state on disk, so
    memory does not grow with the keys.
    """
    keyed = page_stream if key in page_stream.columns else page_stream.withColumn(key, content_hash("html"))
    if event_time is None:
        page_stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", DISK_STATE)
        return keyed.dropDuplicates([key])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def _latest(key: str, order: list[str]):
    """Folds a log to the row per key that is greatest in `order`."""

    def fold(log: DataFrame) -> DataFrame:
        others = [c for c in log.columns if c != key and c not in order]
        best = log.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("_b"))
        return best.select(*[F.col(key) if c == key else F.col(f"_b.{c}").alias(c) for c in log.columns])

    return fold


def stream_first_seen(page_stream: DataFrame, path: str, key: str = "hash", order: str = "page_id", **runs):
    """Exact dedup against everything ever seen: a writer whose log at `path` holds the first captures.

    Keys are kept in levels of runs (`KeyRuns`, which `runs` is passed to); captures are written once.
    """
    from pagetable.operators.frontier import first_per_key

    keyed = page_stream if key in page_stream.columns else page_stream.withColumn(key, content_hash("html"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        KeyRuns(batch.sparkSession, path, key, **runs).append(first_per_key(batch, key, order), batch_id)

    return keyed.writeStream.foreachBatch(merge)


def first_seen(spark: SparkSession, path: str, schema: T.StructType, key: str = "hash") -> DataFrame:
    """The captures that a `stream_first_seen` log holds."""
    return KeyRuns(spark, path, key).rows(schema)


OUTCOMES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("contenttype", T.StringType()),
        T.StructField("contentlength", T.LongType()),
        T.StructField("lastmodified", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
)


def _outcomes(spark: SparkSession, path: str) -> BatchLog:
    return BatchLog(spark, path, OUTCOMES, _latest("url", ["batch", "seq"]))


def stream_frontier(capture_stream: DataFrame, path: str):
    """State of every captured URL as a log of outcomes; `current_frontier` gives the latest state per URL.

    Appending costs what the batch holds; folding keeps the latest outcome per URL.
    """
    gated = gate_captures(capture_stream)
    rows = gated.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OUTCOMES])
    return rows.writeStream.foreachBatch(lambda batch, number: _outcomes(batch.sparkSession, path).append(batch, number))


def current_frontier(spark: SparkSession, path: str) -> DataFrame:
    """Latest outcome per URL of a `stream_frontier` log."""
    return _latest("url", ["batch", "seq"])(_outcomes(spark, path).rows()).drop("batch")


SKETCHES = T.StructType([T.StructField("urls", T.BinaryType()), T.StructField("hashes", T.BinaryType())])


def _united(log: DataFrame) -> DataFrame:
    """Folds a log of sketches to one row (none for an empty log)."""
    both = log.agg(*[F.hll_union_agg(c).alias(c) for c in SKETCHES.names], F.max("batch").alias("batch"))
    return both.where("batch is not null")


def _sketches(spark: SparkSession, path: str) -> BatchLog:
    return BatchLog(spark, path, SKETCHES, _united)


def stream_distinct(page_stream: DataFrame, path: str, precision: int = 12):
    """Different URLs and contents so far: a writer whose log at `path` holds one row of sketches per batch.

    A sketch has at most 2^`precision` registers, however many pages a batch has, and uniting is idempotent, so copies
    across batches count once. The relative standard error is about 1.04 / 2^(precision / 2), 1.6 % by default.
    """
    keyed = page_stream if "hash" in page_stream.columns else page_stream.withColumn("hash", content_hash("html"))
    keys = keyed.select("url", "hash")

    def merge(batch: DataFrame, number: int) -> None:
        sketch = lambda c: F.hll_sketch_agg(c, precision)
        _sketches(batch.sparkSession, path).append(batch.agg(sketch("url").alias("urls"), sketch("hash").alias("hashes")), number)

    return keys.writeStream.foreachBatch(merge)


def current_distinct(spark: SparkSession, path: str) -> DataFrame:
    """(urls, hashes): the estimates of a `stream_distinct` log; no row before the first batch."""
    united = _united(_sketches(spark, path).rows())
    return united.select(*[F.hll_sketch_estimate(c).alias(c) for c in SKETCHES.names])


def stream_progress(log_stream: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Progress figures per time window; late pages are waited for up to `delay`."""
    return progress_windows(log_stream.withWatermark(ts, delay), ts, width)


def stream_windows(log_stream: DataFrame, path: str, ts: str = "ts", width: str = "1 hour", delay: str = "1 hour"):
    """Progress windows as a log of their states, so that windows still open are there too; see `current_windows`."""
    progress = stream_progress(log_stream, ts, width, delay)
    log = lambda spark: BatchLog(spark, path, progress.schema, _latest("window_start", ["batch"]))
    return progress.writeStream.outputMode("update").foreachBatch(lambda batch, number: log(batch.sparkSession).append(batch, number))


def current_windows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The latest state of every window of a `stream_windows` log."""
    fold = _latest("window_start", ["batch"])
    return fold(BatchLog(spark, path, schema, fold).rows()).drop("batch")


def save_stream(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None, **options) -> StreamingQuery:
    """Write a stream as Parquet, saving every `interval`; without one, drain what is there and stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").options(path=path, checkpointLocation=checkpoint, **options)
    trigger = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return trigger.start()
