"""Run analytics over a page log: hit rate, stopping rules, speed, summaries.

A log has one row per fetched page: `seq` (order), `hit` (records extracted), `handling_s`,
`bytes`, `host`, and optionally `reached` (the page got as far as extraction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetable.functions.urls import url_host
from pagetable.functions.values import elapsed_hms
from pagetable.operators.scan import prefix_scan


def running_hit_rate(log: DataFrame, seq: str = "seq", hit: str = "hit", start: tuple[int, int] = (0, 0)) -> DataFrame:
    """+ `hit_rate`: records extracted / pages fetched before each page starts (0 for the first).

    `start`: (records, pages) before the log begins.
    """
    scanned = prefix_scan(
        log,
        seq,
        {"_hits": ("sum", F.col(hit).cast("long")), "_done": ("count", F.col(seq))},
        inclusive=False,
    )
    hits, done = F.coalesce("_hits", F.lit(0)) + F.lit(start[0]), F.col("_done") + F.lit(start[1])
    rate = F.when(done > 0, hits / done).otherwise(F.lit(0.0))
    return scanned.select(*log.columns, rate.alias("hit_rate"))


def below_rate_streak(
    log: DataFrame,
    min_rate: float,
    samples: int,
    seq: str = "seq",
    hit: str = "hit",
    reached: str | None = None,
    start: tuple[int, int, int] = (0, 0, 0),
) -> DataFrame:
    """+ `hit_rate`, `streak` (consecutive pages below the minimum up to here).

    Only pages that reached extraction are tested; the others keep the streak as it is. `start`: (records, pages,
    streak) before the log begins, as `streak_state` gives them for the part before.
    """
    rated = running_hit_rate(log, seq, hit, start[:2])
    tested = F.col(reached) if reached else F.lit(True)
    below = F.col("hit_rate") < F.lit(float(min_rate))
    marked = rated.withColumn("_below", F.when(tested, below))
    counted = prefix_scan(marked, seq, {"_low": ("count", F.when(F.col("_below"), F.lit(1)))})
    # count of low pages up to the last page that reset the streak
    scanned = prefix_scan(counted, seq, {"_base": ("max", F.when(~F.col("_below"), F.col("_low")))})
    streak = (F.col("_low") - F.coalesce(F.col("_base"), F.lit(-start[2]))).cast("long")
    return scanned.select(*rated.columns, streak.alias("streak"))


def streak_state(streaks: DataFrame, start: tuple[int, int, int] = (0, 0, 0), seq: str = "seq", hit: str = "hit") -> tuple[int, int, int]:
    """(records, pages, streak) at the end of a log that began with `start`."""
    row = streaks.agg(F.sum(hit).alias("hits"), F.count("*").alias("n"), F.max_by("streak", seq).alias("streak")).first()
    return start[0] + (row["hits"] or 0), start[1] + row["n"], start[2] if row["streak"] is None else row["streak"]


def stop_seq(streaks: DataFrame, samples: int, seq: str = "seq") -> DataFrame:
    """One row: the first page whose streak is long enough, NULL if none."""
    return streaks.where(F.col("streak") >= samples).agg(F.min(seq).alias("stop"))


def until_rate_stop(
    log: DataFrame, min_rate: float, samples: int, seq: str = "seq", hit: str = "hit", reached: str | None = None
) -> DataFrame:
    """The log up to and including the page at which the run stops."""
    streaks = below_rate_streak(log, min_rate, samples, seq, hit, reached)
    stop = stop_seq(streaks, samples, seq)
    return log.where(F.col(seq) <= F.coalesce(stop.scalar(), F.lit(2**63 - 1)))


def sampled_speed(log: DataFrame, samples: int = 50, seq: str = "seq", handling: str = "handling_s") -> DataFrame:
    """+ `avg_handling_s`: running mean over a sample list that is emptied every `samples` pages."""
    numbered = prefix_scan(log, seq, {"_rn": ("count", F.col(seq))})
    block = F.floor((F.col("_rn") - 1) / F.lit(samples))
    w = Window.partitionBy("_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.withColumn("_b", block).withColumn("avg_handling_s", F.avg(handling).over(w)).select(*log.columns, "avg_handling_s")
    )


def same_host_as_previous(log: DataFrame, seq: str = "seq", host: str = "host") -> DataFrame:
    """+ `same_host`: is the page on the host of the page before it?"""
    scanned = prefix_scan(
        log, seq, {"_last": ("max", F.struct(F.col(seq).alias("s"), F.col(host).alias("h")))}, inclusive=False
    )
    return scanned.select(*log.columns, F.coalesce(F.col("_last.h") == F.col(host), F.lit(False)).alias("same_host"))


def add_host(log: DataFrame, url: str = "url") -> DataFrame:
    return log.withColumn("host", url_host(url))


def hit_rate(log: DataFrame, hit: str = "hit") -> DataFrame:
    n = F.count("*")
    return log.agg(F.when(n > 0, F.coalesce(F.sum(hit), F.lit(0)) / n).otherwise(F.lit(0.0)).alias("hit_rate"))


def throughput(log: DataFrame, elapsed_s: float | None = None, handling: str = "handling_s", size: str = "bytes") -> DataFrame:
    """(pages_per_s, kb_per_s): from the mean handling time, and from bytes over elapsed time."""
    elapsed = F.sum(handling) if elapsed_s is None else F.lit(float(elapsed_s))
    mean = F.avg(handling)
    return log.agg(
        F.when(mean > 0, 1 / mean).alias("pages_per_s"),
        F.when(elapsed > 0, F.sum(size) / elapsed / 1024).otherwise(F.lit(-1.0)).alias("kb_per_s"),
    )


def bytes_downloaded(frontier: DataFrame) -> DataFrame:
    """Content length of the pages that were accepted (their hash is stored)."""
    accepted = frontier.where(F.col("hash").isNotNull())
    return accepted.agg(F.coalesce(F.sum("contentlength"), F.lit(0)).alias("bytes"))


def run_summary(log: DataFrame, queue_size: int | None = None, handling: str = "handling_s", size: str = "bytes", hit: str = "hit") -> DataFrame:
    """One row: elapsed, nproc, nextracted, qsize, avgpps, kbps, hitrate."""
    n, elapsed = F.count("*"), F.coalesce(F.sum(handling), F.lit(0.0)).cast("double")
    totals = log.agg(
        elapsed.alias("elapsed_s"),
        n.alias("nproc"),
        F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("nextracted"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("_bytes"),
    )
    return totals.select(
        elapsed_hms("elapsed_s").alias("elapsed"),
        "nproc",
        "nextracted",
        (F.col("nproc") if queue_size is None else F.lit(queue_size).cast("long")).alias("qsize"),
        F.when(F.col("elapsed_s") > 0, F.col("nproc") / F.col("elapsed_s")).alias("avgpps"),
        F.when(F.col("elapsed_s") > 0, F.col("_bytes") / F.col("elapsed_s") / 1024).alias("kbps"),
        F.when(F.col("nproc") > 0, F.col("nextracted") / F.col("nproc")).otherwise(F.lit(0.0)).alias("hitrate"),
    )


def progress_windows(log: DataFrame, ts: str = "ts", width: str = "1 hour", handling: str = "handling_s", hit: str = "hit") -> DataFrame:
    """Pages, extracted records, hit rate and speed per time window (batch or stream)."""
    grouped = log.groupBy(F.window(ts, width).alias("_w")).agg(
        F.count("*").alias("fetched"),
        F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("extracted"),
        F.avg(handling).alias("avg_handling_s"),
    )
    return grouped.select(
        F.col("_w.start").alias("window_start"),
        "fetched",
        "extracted",
        (F.col("extracted") / F.col("fetched")).alias("hit_rate"),
        F.when(F.col("avg_handling_s") > 0, 1 / F.col("avg_handling_s")).alias("pages_per_s"),
    )
