"""Logs of streams: writers stopped anywhere, readers beside them, bytes per batch."""

import random

import pytest
from pyspark.sql import types as T

from pagetable.streaming import log as lg
from pagetable.streaming.pages import _latest

ROW = T.StructType([T.StructField("url", T.StringType()), T.StructField("seq", T.LongType())])


class Stopped(Exception):
    pass


def stop_at(monkeypatch, target, name, after=0):
    """The method raises from its call number `after` on; 'late' makes it do its work first."""
    kept, calls = getattr(target, name), []

    def stopped(*args, **kwargs):
        calls.append(1)
        if len(calls) > after:
            raise Stopped
        return kept(*args, **kwargs)

    monkeypatch.setattr(target, name, stopped)


def batch_log(spark, path):
    return lg.BatchLog(spark, path, ROW, _latest("url", ["batch", "seq"]), every=3)


@pytest.mark.parametrize("where", ["before the fold is written", "after the fold, before the batch", "before the commit", "after the commit"])
def test_a_stopped_fold_loses_nothing(spark, tmp_path, monkeypatch, where):
    log, want = batch_log(spark, str(tmp_path / "log")), {}
    for number in range(9):
        new = [(f"u{number % 4}", number), (f"own{number}", number)]
        rows = spark.createDataFrame(new, ROW)
        folds = len(log.manifest.current()[1].get("batches", {})) >= 3
        if folds:
            with monkeypatch.context() as m:
                if where.startswith("before the fold"):
                    stop_at(m, lg._Log, "_write")
                elif where.startswith("after the fold"):
                    stop_at(m, lg._Log, "_write", 1)
                elif where == "before the commit":
                    stop_at(m, lg.Manifest, "commit")
                else:
                    stop_at(m, lg._Log, "_sweep")
                with pytest.raises(Stopped):
                    batch_log(spark, str(tmp_path / "log")).append(rows, number)
            seen = {r["url"]: r["seq"] for r in log.fold(log.rows()).collect()}
            assert seen == (want | dict(new) if where == "after the commit" else want)
        log.append(rows, number)
        want.update(new)
        assert {r["url"]: r["seq"] for r in log.fold(log.rows()).collect()} == want
    data = {p.name for p in (tmp_path / "log" / "data").iterdir()}
    live = log.manifest.current()[1]
    assert {live["folded"], *live["batches"].values()} <= data


def test_readers_outlive_a_fold(spark, tmp_path):
    log = batch_log(spark, str(tmp_path / "log"))
    for number in range(3):
        log.append(spark.createDataFrame([(f"u{number}", number)], ROW), number)
    reader = log.rows()
    log.append(spark.createDataFrame([("u3", 3)], ROW), 3)  # folds
    assert {r["url"] for r in reader.collect()} == {"u0", "u1", "u2"}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    manifest = lg.Manifest(spark, str(tmp_path / "m"))
    assert manifest.current() == (0, {})
    manifest.commit(1, {"a": "ü"})
    with pytest.raises(RuntimeError):
        manifest.commit(1, {"a": 2})
    assert manifest.current() == (1, {"a": "ü"})


@pytest.mark.parametrize("where", ["none", "rows", "run", "commit"])
def test_first_rows_per_key(spark, tmp_path, monkeypatch, where):
    """Against a plain set, with batches repeated after a stop, merges over two levels and rows without a key."""
    draw, want, nulls = random.Random(4), {}, 0
    runs = lg.KeyRuns(spark, str(tmp_path / "keys"), "url", fanout=2, per_file=4)
    for number in range(8):
        new = {f"k{draw.randrange(60)}": number * 100 + i for i in range(9)}
        rows = spark.createDataFrame([*new.items(), (None, -number)], ROW)
        if where != "none" and number in (3, 4, 6):
            with monkeypatch.context() as m:
                if where == "rows":
                    stop_at(m, lg.KeyRuns, "_run")
                elif where == "run":
                    stop_at(m, lg.KeyRuns, "_run", 1)
                    stop_at(m, lg.Manifest, "commit")
                else:
                    stop_at(m, lg.Manifest, "commit")
                with pytest.raises(Stopped):
                    runs.append(rows, number)
            assert {r["url"]: r["seq"] for r in runs.rows(ROW).collect() if r["url"]} == want
        for _ in range(2 if number == 5 else 1):  # a batch that was committed is repeated
            runs.append(rows, number)
        want = {**new, **want}
        nulls += 1
        got = [(r["url"], r["seq"]) for r in runs.rows(ROW).collect()]
        assert {u: s for u, s in got if u} == want and len(got) == len(want) + nulls
    assert max(r["level"] for r in runs.manifest.current()[1]["runs"]) >= 2


def file_bytes(spark):
    """(read, written) by this JVM so far, which runs driver and tasks."""
    told = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in told), sum(s.getBytesWritten() for s in told)


def test_bytes_per_batch_do_not_follow_the_history(spark, tmp_path):
    """A few keys against a long and a short history: what is read of the long one is a few files."""
    spent = {}
    for name, size in (("short", 4_000), ("long", 64_000)):
        runs = lg.KeyRuns(spark, str(tmp_path / name), "url", fanout=4, per_file=500)
        runs.append(spark.range(size).selectExpr("concat('old', id) AS url", "id AS seq"), 0)
        for number in range(1, 4):
            rows = spark.createDataFrame([(f"old{number}", 1), (f"new{number}", 2)], ROW)
            start = file_bytes(spark)
            runs.append(rows, number)
            spent[name, number] = [b - a for a, b in zip(start, file_bytes(spark))]
        assert runs.rows(ROW).count() == size + 3
    for number in range(1, 4):
        for short, long in zip(spent["short", number], spent["long", number]):
            assert long <= 1.5 * short + 20_000, spent


def test_distinct_sketches(spark, tmp_path):
    from pyspark.sql import functions as F

    from pagetable.streaming.pages import current_distinct, stream_distinct

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(30000).select(F.concat(F.lit("u"), F.col("id") % 20000).alias("url"), F.concat(F.lit("h"), F.col("id") % 700).alias("hash"))
    rows.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert current_distinct(spark, out).count() == 0
    query = stream_distinct(stream, out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = current_distinct(spark, out).collect()
    assert len(got) == 1 and abs(got[0]["urls"] - 20000) < 1000 and abs(got[0]["hashes"] - 700) < 35
