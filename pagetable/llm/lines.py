"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetable.llm.store import folder, parts_of, spare, stored
from pagetable.llm.worker import small, text_bytes, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_CHARS = 10


def _key(line: bytes, least: int) -> bytes | None:
    """The hash of a line that counts: stripped, ASCII letters in lower case, at least `least` code points."""
    line = line.strip().lower()
    if len(line) < least or not line.isascii() and len(line.decode()) < least:
        return None
    return hashlib.md5(line, usedforsecurity=False).digest()


class LineRuns:
    """A store of line hashes with the first document of each: levels of runs, each bucketed and sorted by hash.

    `add` takes a batch of (h, first): hashes that an earlier run has are removed by merge anti-joins, the rest
    becomes a run of level 0. When a level has `fanout` runs they are compacted to one of the next level, so there
    are at most (fanout - 1) * log(batches) runs and a hash is rewritten once per level. A hash is in one run only.
    Runs are tables in the shared folder; `drop` removes their names from the catalog.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.root, self.buckets = folder(spark, "line-runs"), parts_of(spark)
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("h", "first").repartition(self.buckets, "h")
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").saveAsTable(name)
        self.names.append(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, batch: DataFrame) -> None:
        new = batch.groupBy("h").agg(F.min("first").alias("first"))
        for name in [n for level in self.levels for n in level]:
            new = new.join(self.spark.table(name).select("h"), "h", "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.union(self.spark.table(name))
            self._write(merged, level + 1)
            level += 1

    def all(self) -> DataFrame:
        """(h, first) of all runs, read from their files without bucketing, so that skewed joins can be split."""
        paths = [f"{self.root}/{n}" for level in self.levels for n in level]
        return self.spark.read.schema("h binary, first long").parquet(*paths)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 4, least: int = MIN_CHARS
) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and `n_lines` (before), `n_dropped`.

    A line counts if it has at least `least` code points without ASCII white space at its ends; ASCII case is ignored.
    It stays in the smallest doc_id that holds it, with all its repeats there, and goes from all others. Other lines
    stay. Batches are ranges of ascending doc_id, so the document that a run names for a hash is the smallest.

    NULL text stays NULL and counts as one empty line. Rows of one doc_id count as one document. Rows with a NULL
    doc_id hold no line and lose none. An empty table gives an empty one. A column called n_lines or n_dropped is an
    error; other names are free. Hashes have 128 bits. Wide rows are shuffled once, by doc_id.
    """
    if clash := {c.lower() for c in docs.columns} & {"n_lines", "n_dropped"}:
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")

    def hashes(rows):
        for batch in small(rows):
            ids, keys = [], []
            for doc, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = {k for line in data.split(b"\n") if (k := _key(line, least))}
                ids.extend([doc] * len(own))
                keys.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc", "h"])

    shares = [(i + 1) / batches for i in range(batches - 1)]
    bounds = sorted(set(narrow.approxQuantile("doc", shares, 0.01))) if shares else []
    which = sum([(F.col("doc") > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    held = stored(narrow.mapInArrow(hashes, "doc long, h binary").withColumn("batch", which), "line-hashes")
    runs = LineRuns(spark)
    for k in range(len(bounds) + 1):
        runs.add(held.where(F.col("batch") == k).select("h", F.col("doc").alias("first")))
    goes = held.join(runs.all(), "h").where("first < doc")
    goes = goes.groupBy("doc").agg(F.collect_set("h").alias("goes"))
    runs.drop()  # the files stay, and are read by path

    key, gone = spare("doc_key", docs.columns), spare("goes", docs.columns)
    left = docs.withColumn(key, F.col(doc_id).cast("long"))
    joined = left.join(goes.select(F.col("doc").alias(key), F.col("goes").alias(gone)), key, "left").drop(key)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    columns, at = docs.columns, docs.columns.index(text)
    kind = pa.string()

    def rebuild(rows):
        for batch in small(rows):
            before, texts, n_lines, n_dropped = batch.column(at), [], [], []
            for data, drop in zip(text_bytes(before), batch.column(len(columns)).to_pylist()):
                lines = data.split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [line for line in lines if _key(line, least) not in drop]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(b"\n".join(lines))
            kept = pa.array(texts, pa.binary(), mask=before.is_null().to_numpy(zero_copy_only=False)).cast(kind)
            out = with_columns(batch, columns, n_lines=pa.array(n_lines, pa.int64()), n_dropped=pa.array(n_dropped, pa.int64()))
            yield out.set_column(at, text, kept)

    return joined.select(*columns, gone).mapInArrow(rebuild, schema)
