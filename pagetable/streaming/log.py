"""Tables that a stream adds to batch by batch: what is live is said by a manifest that is put in place last."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetable.plans.checkpoints import drop_folder


class Manifest:
    """Numbered JSON files below `path`; the one with the highest number holds. A file is written under another name and
    renamed, so a reader meets a whole one or none. A log has one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        target = self._hadoop.Path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(target)) if self._files.exists(target) else []

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names(self.path) if n.endswith(".json")]

    def current(self) -> tuple[int, dict]:
        """The number and content of the newest manifest; 0 and nothing if there is none."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        source = self._files.open(self._hadoop.Path(f"{self.path}/{numbers[-1]:012d}.json"))
        try:
            return numbers[-1], json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def commit(self, number: int, content: dict) -> None:
        final, draft = self._hadoop.Path(f"{self.path}/{number:012d}.json"), self._hadoop.Path(f"{self.path}/.{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"another writer put manifest {number} in place below {self.path}")

    def forget(self, before: int) -> None:
        """Older manifests, and drafts of writers that were stopped, go."""
        for n in self._numbers():
            if n < before:
                self._files.delete(self._hadoop.Path(f"{self.path}/{n:012d}.json"), False)
        for name in self.names(self.path):
            if name.startswith(".") and not name.endswith(".crc"):
                self._files.delete(self._hadoop.Path(f"{self.path}/{name}"), False)


class _Log:
    """Folders below `path`/data that a manifest names. What no manifest names was left by a writer that was stopped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifests")

    def _write(self, rows: DataFrame, name: str, *parts: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*parts) if parts else rows.write
        writer.parquet(f"{self.path}/data/{folder}")
        return folder

    def _at(self, folder: str) -> str:
        return f"{self.path}/data/{folder}"

    def _sweep(self, number: int, live: set[str]) -> None:
        """Removes the folders that neither the manifest `number` nor the one before names. What a fold replaces so stays
        until the next one: readers that began before it go on."""
        for folder in self.manifest.names(f"{self.path}/data"):
            if folder not in live:
                drop_folder(self.spark, self._at(folder))
        self.manifest.forget(number - 1)


class BatchLog(_Log):
    """A table that grows by one folder per micro-batch; a repeated batch takes the place of its first attempt.

    `fold` reduces the rows of many batches to those that still matter. When `every` batches stand alone, all earlier ones are
    folded into one table, so a reader meets one folded table and at most `every` + 1 folders. The batch's rows and the fold count
    from the commit of the manifest on: a writer stopped anywhere before leaves the log as it was, and the repeated
    batch does the work anew. A log belongs to one checkpoint, whose batch numbers it keeps.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fold, every: int = 20):
        super().__init__(spark, path)
        self.fold, self.every = fold, every
        self.schema = T.StructType([f for f in schema.fields if f.name != "batch"])
        self.whole = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])

    def _rows(self, state: dict, before: int | None) -> DataFrame:
        early = lambda n: before is None or n < before
        out = self.spark.createDataFrame([], self.whole)
        if state.get("folded") and early(state["upto"]):
            out = self.spark.read.schema(self.whole).parquet(self._at(state["folded"]))
        for number, folder in sorted((int(n), f) for n, f in state.get("batches", {}).items()):
            if early(number):
                one = self.spark.read.schema(self.schema).parquet(self._at(folder))
                out = out.unionByName(one.withColumn("batch", F.lit(number).cast("long")))
        return out

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows with their `batch`, or those of earlier batches: a repeated batch does not see its first attempt."""
        return self._rows(self.manifest.current()[1], before)

    def append(self, rows: DataFrame, number: int) -> None:
        version, state = self.manifest.current()
        batches = state.get("batches", {})
        after = {"folded": state.get("folded"), "upto": state.get("upto", -1), "batches": dict(batches)}
        earlier = [n for n in batches if int(n) < number]
        folds = len(earlier) >= self.every
        if folds:
            after["folded"] = self._write(self.fold(self._rows(state, number)), "folded")
            after["upto"] = number - 1
            after["batches"] = {n: f for n, f in batches.items() if n not in earlier}
        after["batches"][str(number)] = self._write(rows.select(*self.schema.names), f"batch-{number}")
        self.manifest.commit(version + 1, after)
        if folds:
            live = {s.get("folded") for s in (state, after)}.union(state["batches"].values(), after["batches"].values())
            self._sweep(version + 1, live)


KEYS_PER_FILE = 1 << 16
PRUNE_UPTO = 4096


class KeyRuns(_Log):
    """All keys ever added, as runs of disjoint keys in levels: `fanout` runs of a level are merged into one of the next, so a
    key is rewritten once per level.

    A run is cut into buckets by the first bits of the keys' hashes, about `per_file` keys each, sorted. A batch
    reads of every run only the buckets that its own keys fall into: what it reads and writes grows with the number of levels,
    not with the history. Rows are kept apart, one folder per batch, and are never rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fanout: int = 8, per_file: int = KEYS_PER_FILE):
        super().__init__(spark, path)
        self.key, self.fanout, self.per_file = key, fanout, per_file

    def _hash(self):
        return F.shiftrightunsigned(F.xxhash64(self.key), 32)

    def _bucket(self, bits: int):
        return F.shiftright(self._hash(), 32 - bits).cast("int")

    def _run(self, keys: DataFrame, level: int, last: int) -> dict:
        """Writes a run and describes it."""
        rows = keys.count()
        bits = max(math.ceil(math.log2(max(rows, 1) / self.per_file)), 0)
        dealt = keys.withColumn("bucket", self._bucket(bits)).repartition("bucket").sortWithinPartitions("bucket", self.key)
        return {"folder": self._write(dealt, f"keys-{level}", "bucket"), "level": level, "bits": bits, "rows": rows, "last": last}

    def _read(self, run: dict, kind: T.DataType) -> DataFrame:
        whole = T.StructType([T.StructField(self.key, kind), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(self._at(run["folder"]))

    def _seen(self, runs: list[dict], keys: DataFrame) -> DataFrame | None:
        """The keys of the runs, read only where `keys` may meet them."""
        runs = [r for r in runs if r["rows"]]
        if not runs:
            return None
        kind = keys.schema[self.key].dataType
        bits = max(r["bits"] for r in runs)
        # a batch with keys in many buckets reads them all
        met = [r[0] for r in keys.select(self._bucket(bits)).distinct().limit(PRUNE_UPTO + 1).collect()] if bits else []
        out = None
        for run in runs:
            own = self._read(run, kind)
            if run["bits"] and len(met) <= PRUNE_UPTO:
                own = own.where(F.col("bucket").isin(sorted({b >> (bits - run["bits"]) for b in met})))
            out = own if out is None else out.unionAll(own)
        return out.select(self.key)

    def rows(self, schema: T.StructType) -> DataFrame:
        """The rows of all batches that were committed."""
        last = self.manifest.current()[1].get("last", -1)
        if last < 0:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(whole).parquet(f"{self.path}/rows").where(F.col("batch") <= last).drop("batch")

    def append(self, rows: DataFrame, number: int) -> None:
        """Adds those of `rows` (one per key) whose key no earlier batch has. Rows without a key are always added."""
        version, state = self.manifest.current()
        runs = [r for r in state.get("runs", []) if r["last"] < number]
        seen = self._seen(runs, rows)
        fresh = rows if seen is None else rows.join(seen, self.key, "left_anti").select(*rows.columns)
        folder = f"{self.path}/rows/batch={number}"
        fresh.write.mode("overwrite").parquet(folder)
        added = self.spark.read.schema(rows.schema).parquet(folder).select(self.key).where(F.col(self.key).isNotNull())
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fanout:
            merged = None
            for r in full:
                own = self._read(r, rows.schema[self.key].dataType).select(self.key)
                merged = own if merged is None else merged.unionAll(own)
            runs = [r for r in runs if r["level"] != level] + [self._run(merged, level + 1, max(r["last"] for r in full))]
            level += 1
        after = {"last": number, "runs": [*runs, self._run(added, 0, number)]}
        self.manifest.commit(version + 1, after)
        if level:
            self._sweep(version + 1, {r["folder"] for s in (state, after) for r in s["runs"]})
