"""Embedding whitening with MLlib block matrices: scatter by transpose-multiply, local eigh, projection by multiplication."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetable.llm.store import stored
from pagetable.llm.worker import small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 16
BLOCK_ENTRIES = 1 << 16
BLOCKS_PER_SPLIT = 16
SCALE, ORIGIN = 64, 1_000_000
WIDEST = float(1 << 52)

_BLOCK = "dim int, part int, k int, ids array<long>, x array<long>, sums array<long>"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows_of(dim: int) -> int:
    """Rows of a block: its entries are bounded, and the sums of its whole numbers fit a long."""
    return min(max(BLOCK_ENTRIES // max(dim, 1), 16), 2000)


def _blocks(rows: DataFrame) -> DataFrame:
    """(vec_id, x) as blocks of rows of equal length: ids, entries row after row, sums per dimension. Blocks are numbered
    within their partition and length, so nothing is shuffled; a block's place is (dim, part, k)."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), {}
        held: dict[int, list] = {}  # per length the rows that do not fill a block yet

        def block(dim, ids, x):
            k = made[dim] = made.get(dim, -1) + 1
            entries = pa.array([x.reshape(-1)], pa.list_(pa.int64()))
            sums = pa.array([x.sum(axis=0)], pa.list_(pa.int64()))
            numbers = [pa.array([v], pa.int32()) for v in (dim, part, k)]
            return pa.RecordBatch.from_arrays([*numbers, pa.array([ids], pa.list_(pa.int64())), entries, sums], names=["dim", "part", "k", "ids", "x", "sums"])

        for batch in small(batches, 4096):
            ids, vectors = batch.column(0), batch.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                old_ids, old = held.pop(dim, ([], np.zeros((0, dim), np.int64)))
                own, x, size = old_ids + ids.take(pa.array(at)).to_pylist(), np.concatenate([old, x]), _rows_of(dim)
                whole = len(x) // size * size
                for a in range(0, whole, size):
                    yield block(dim, own[a : a + size], x[a : a + size])
                if whole < len(x):
                    held[dim] = (own[whole:], x[whole:])
        for dim, (ids, x) in held.items():
            yield block(dim, ids, x)

    return rows.mapInArrow(run, _BLOCK)


def _places(blocks: DataFrame) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """Per (dim, part) the number of its first block among those of its length, and how many blocks a length has.
    One row per task and length comes to the driver."""
    first, total = {}, {}
    for r in blocks.groupBy("dim", "part").agg(F.count("*").alias("n")).orderBy("dim", "part").collect():
        first[r["dim"], r["part"]] = total.get(r["dim"], 0)
        total[r["dim"]] = total.get(r["dim"], 0) + r["n"]
    return first, total


def _matrix(blocks: DataFrame, dim: int, first: dict, total: int, mean: np.ndarray, wide: int) -> BlockMatrix:
    """The centred rows of one length as a distributed matrix. Block number b stands at (b // wide, b % wide): `wide` is
    1 for rows below each other."""
    size = _rows_of(dim)

    def cell(row):
        x = np.asarray(row["x"], np.int64).reshape(-1, dim)
        b = first[dim, row["part"]] + row["k"]
        return (b // wide, b % wide), DenseMatrix(len(x), dim, (x - mean).reshape(-1), True)

    own = blocks.where(F.col("dim") == dim).select("part", "k", "x").rdd.map(cell)
    return BlockMatrix(own, size, dim, -(-total // wide) * size, wide * dim)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right, the sum over the inner blocks dealt to `splits` tasks for every block of the result (Python's
    multiply has no such parameter; without it one task would meet all blocks of a narrow result)."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


class Axes:
    """The first components of one length: mean, projection (columns), shares of the variance."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        # beyond rounding there is no variance to divide by
        real = values > len(covariance) * np.finfo(float).eps * max(values.max(initial=0), 0) * 4
        self.real = real & (values > 0)
        self.turn = np.where(self.real, vectors / np.sqrt(np.where(self.real, values, 1)), 0)
        trace = float(np.trace(covariance))
        self.shares = np.where(self.real, values / trace if trace > 0 else 0.0, 0.0)


def _mean(n: int, sums: list[int]) -> np.ndarray:
    """S / n to the last bit of a double, also for sums beyond 2^53."""
    return np.array([s // n + (s % n) / n for s in sums], float)


def _identity_error(blocks: DataFrame, dim: int, axes: Axes) -> float:
    """The largest entry of the covariance of whitened fit rows minus the identity, from the projected rows themselves.
    Tasks give one small matrix per block; means are taken out before multiplying."""
    mean, turn, real = _mean(axes.n, axes.sums), axes.turn, axes.real
    own = blocks.where(F.col("dim") == dim).select("x").rdd

    def projected(row):
        return (np.asarray(row["x"], np.int64).reshape(-1, dim) - mean) @ turn

    centre = own.map(lambda r: projected(r).sum(axis=0)).treeReduce(np.add) / axes.n

    def square(row):
        z = projected(row) - centre
        return z.T @ z

    off = own.map(square).treeReduce(np.add) / axes.n - np.eye(len(real))
    return float(np.abs(off[np.ix_(real, real)]).max(initial=0.0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2 per row; NULL where a long does not hold one."""
    far = n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, sums), default=0)
    if far < 2**62 and len(sums) * (np.abs(n * x.astype(float) - np.array(sums, float)).max(initial=0) + 2) ** 2 < 2**62:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    told = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in told]


def whiten(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row with a vector and component.

    Entries c become whole numbers x = floor(64 c) + 1000000. Mean and covariance are those of the distinct x vectors
    (the fit list, n of them): centred rows are indexed into distributed blocks, the transposed matrix times the matrix is
    the scatter, a local eigh of it gives the axes, and the blocks of all rows times the whitening matrix are the result.
    Blocks are cut where rows lie, so no row is moved to form one. For the projection they stand in a square grid
    against a block-diagonal whitening matrix, because MLlib deals a product to tasks by a square grid.

    Rows whose vector is NULL or holds a NULL or non-finite entry are left out; so are empty vectors, which have no
    component. Vectors of another length are whitened apart, with their own n and axes. Repeated rows and NULL ids stay. A component
    without variance (fewer distinct vectors than dimensions, constant entries) has `whitened` and `explained` 0 and counts for
    nothing in `identity_error`. 64 c beyond 2^52 counts as 2^52. `deviation`, the exact sum of (n x - S)^2, is NULL where a long does
    not hold it. Extra columns are ignored; an empty table gives an empty one.

    On the driver: sums and a covariance per length (a square of the dimension), one row per task, one index per block.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    given = given.where(F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(WIDEST)), F.lit(-WIDEST))) + ORIGIN)
    given = given.select("vec_id", whole.alias("x"))
    all_blocks = stored(_blocks(given), "whitening-rows")
    fit = all_blocks.select("dim", F.explode(_cut("x", "dim")).alias("x")).distinct()
    fit_blocks = stored(_blocks(fit.select(F.lit(None).cast("long").alias("vec_id"), "x")), "whitening-fit")
    summed = fit_blocks.select("dim", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums: dict[int, list[int]] = {}
    for r in summed.orderBy("dim", "at").collect():
        sums.setdefault(r["dim"], []).append(int(r["s"]))
    sizes = {r["dim"]: r["n"] for r in fit_blocks.groupBy("dim").agg(F.sum((F.size("x") / F.col("dim")).cast("long")).alias("n")).collect()}
    first, total = _places(all_blocks)
    fit_first, fit_total = _places(fit_blocks)
    out = None
    for dim in sorted(sizes):
        n, mean = sizes[dim], _mean(sizes[dim], sums[dim])
        centred = _matrix(fit_blocks, dim, fit_first, fit_total[dim], mean, 1)
        scatter = _product(centred.transpose(), centred, -(-fit_total[dim] // BLOCKS_PER_SPLIT)).toLocalMatrix().toArray()
        axes = Axes(n, sums[dim], scatter / n, components)
        error = _identity_error(fit_blocks, dim, axes)
        own = _projected(spark, all_blocks, dim, first, total[dim], axes, error)
        out = own if out is None else out.union(own)
    return out if out is not None else spark.createDataFrame([], _OUT)


def _cut(flat: str, dim: str):
    """The rows of a block as an array of arrays."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / F.col(dim)).cast("int") - 1), lambda i: F.slice(F.col(flat), i * F.col(dim) + 1, F.col(dim)))


def _projected(spark: SparkSession, blocks: DataFrame, dim: int, first: dict, total: int, axes: Axes, error: float) -> DataFrame:
    """The rows of one length times the whitening matrix, with their ids."""
    wide = max(math.isqrt(total), 1)
    mean, turn, width = _mean(axes.n, axes.sums), axes.turn, axes.turn.shape[1]
    centred = _matrix(blocks, dim, first, total, mean, wide)
    cells = spark.sparkContext.range(wide).map(lambda j: ((j, j), DenseMatrix(dim, width, turn.T.reshape(-1))))
    product = centred.multiply(BlockMatrix(cells, dim, width, wide * dim, wide * width))

    def cell(block):
        (i, j), m = block
        return i * wide + j, np.ascontiguousarray(m.toArray()).tobytes()

    projected = spark.createDataFrame(product.blocks.map(cell), "b long, z binary")
    n, sums, shares = axes.n, axes.sums, axes.shares.tolist()

    def numbered(batches):
        for batch in small(batches, 64):
            b = [first[dim, p] + k for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            told = [_deviations(x.values.to_numpy().reshape(-1, dim), n, sums) for x in batch.column(3)]
            columns = [pa.array(b, pa.int64()), batch.column(2), pa.array(told, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "ids", "deviations"])

    named = blocks.where(F.col("dim") == dim).select("part", "k", "ids", "x").mapInArrow(numbered, "b long, ids array<long>, deviations array<long>")

    def flat(batches):
        for batch in small(batches, 16):
            for ids, deviations, z in zip(batch.column(0), batch.column(1), batch.column(2)):
                z = np.frombuffer(z.as_py(), float).reshape(-1, width)
                again = np.repeat(np.arange(len(z)), width)
                columns = [
                    ids.values.take(pa.array(again)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(z))),
                    pa.array(np.full(z.size, n)), deviations.values.take(pa.array(again)), pa.array(z.reshape(-1)),
                    pa.array(np.tile(shares, len(z))), pa.array(np.full(z.size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _OUT.split(", ")])

    return named.join(projected, "b").select("ids", "deviations", "z").mapInArrow(flat, _OUT)
