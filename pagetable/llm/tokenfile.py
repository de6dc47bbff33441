"""Token ids of a corpus in binary blocks: frequency ranks in byte-aligned variable-length coding."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetable.llm.store import folder, parts_of
from pagetable.llm.tokens import ChunkEncoder
from pagetable.llm.worker import once, small, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_IDS = 1 << 18
BLOCK_SCHEMA = (
    "part int, block int, start long, n_ids long, doc_ids array<bigint>, lengths array<int>, control binary, data binary"
)
_WIDTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_TAKEN = np.arange(4) < np.arange(5)[:, None]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks as control bytes (two bits for each rank's number of bytes less one) and data bytes (low byte first)."""
    ranks = ranks.astype("<u4")
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[_TAKEN[width]].tobytes()
    padded = np.zeros(-(-len(width) // 4) * 4, np.uint8)
    padded[: len(width)] = width - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again: widths from a table by control byte, bytes placed by a table of masks."""
    width = _WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_TAKEN[width]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def write_token_files(
    docs: DataFrame, path: str, out: str, end_id: int, doc_id: str = "doc_id", text: str = "text", files: int | None = None
) -> None:
    """Writes below `out`: `blocks`, the coded ids in ascending `doc_id` order, and `ranks`, the id of each rank.

    Every document's ids (those of bpe.encode) are followed by `end_id`. A block is a row of a Parquet file: some
    documents whole and in order, with their numbers of ids, control bytes and data bytes. Files are ranges of
    doc_id, numbered in order by `part`; Spark's committer makes repeated tasks harmless.

    NULL texts are empty; a NULL doc_id comes first; rows of one doc_id follow each other by length and content. An
    empty table gives empty files. Extra columns are ignored. Texts are encoded once: their ids wait in a staging
    table while frequencies are counted over all documents. The rank table has at most one row per vocabulary entry.
    """
    spark = docs.sparkSession
    stage = folder(spark, "token-stage")

    def ids_of(batches):
        encoder = once(("file encoder", path), lambda: ChunkEncoder(path))
        kind = "<u2" if len(encoder.pieces) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        tail, total = np.array([end_id], kind).tobytes(), np.zeros(max(len(encoder.pieces), end_id + 1), np.int64)
        for batch in small(batches, 1536):
            coded = [np.frombuffer(i, "<u4") for i in encoder.encode_many(text_bytes(batch.column(1)))]
            total += np.bincount(np.concatenate([*coded, np.full(len(coded), end_id, "<u4")]), minlength=len(total))
            ids = [i.astype(kind).tobytes() + tail for i in coded]
            wide = pa.array([kind == "<u4"] * len(ids))
            nothing = pa.nulls(len(ids), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), wide, pa.array(ids, pa.binary()), nothing, nothing], names=names)
        used = np.flatnonzero(total)
        row = [None, None, None, used.tolist(), total[used].tolist()]
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    # one row per document, and one per task with the counts of its ids
    names = ["doc_id", "wide", "ids", "used", "times"]
    schema = "doc_id long, wide boolean, ids binary, used array<long>, times array<long>"
    docs.select(F.col(doc_id).cast("long"), text).mapInArrow(ids_of, schema).write.option("compression", "zstd").parquet(stage)
    table = spark.read.schema(schema).parquet(stage)
    staged = table.where("used is null").select("doc_id", "wide", "ids")
    pairs = table.where("used is not null").select(F.explode(F.arrays_zip("used", "times")).alias("p"))
    counts = pairs.groupBy(F.col("p.used").alias("id")).agg(F.sum("p.times").alias("n"))
    # at most one row per vocabulary entry
    by_rank = [(rank, r["id"], r["n"]) for rank, r in enumerate(counts.orderBy(F.desc("n"), "id").collect())]
    spark.createDataFrame(by_rank, "rank long, id long, n long").coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = np.zeros(1 + max([0, *(i for _, i, _ in by_rank)]), np.uint32)
    rank_of[[i for _, i, _ in by_rank]] = [r for r, _, _ in by_rank]

    def blocks(batches):
        part, made, start = TaskContext.get().partitionId(), 0, 0
        waiting, size = [], 0

        def block():
            ranks = np.concatenate([r for _, r in waiting])
            control, data = pack(ranks)
            row = [part, made, start, len(ranks), [d for d, _ in waiting], [len(r) for _, r in waiting], control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _BLOCK_TYPES)], names=_BLOCK_NAMES)

        for batch in small(batches):
            for doc, wide, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                waiting.append((doc, rank_of[_raw(wide, ids)]))
                size += len(waiting[-1][1])
                if size >= BLOCK_IDS:
                    yield block()
                    made, start, waiting, size = made + 1, start + size, [], 0
        if waiting:
            yield block()

    ordered = staged.repartitionByRange(files or parts_of(spark), F.asc("doc_id"))
    ordered = ordered.sortWithinPartitions("doc_id", F.length("ids"), "ids")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{out}/blocks")


_BLOCK_NAMES = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
_BLOCK_TYPES = [
    pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()
]


def _raw(wide: bool, ids) -> np.ndarray:
    return np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): per document the place of its first id in the whole sequence and its ids, as
    little-endian unsigned 32-bit integers. Only one row per file passes through one task, to place the files."""
    table = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
    ranks = spark.read.schema("rank long, id long, n long").parquet(f"{out}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks], "<u4")

    def decode(batches):
        for batch in small(batches, 1):
            offset, start, n, docs, lengths, control, data = (batch.column(i)[0].as_py() for i in range(7))
            ids = id_of[unpack(control, data, n)].tobytes()
            ends = np.cumsum(lengths)
            firsts = ends - lengths
            cut = [ids[4 * a : 4 * b] for a, b in zip(firsts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(firsts + offset + start), pa.array(lengths, pa.int64()), pa.array(cut, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    sizes = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # one row per file: broadcast, so that the blocks are decoded where they are read
    placed = table.join(F.broadcast(offsets), "part")
    return placed.select("offset", "start", "n_ids", "doc_ids", "lengths", "control", "data").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids binary"
    )
