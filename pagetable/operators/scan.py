"""Running aggregates over a global order, without a single-task window.

A long `seq` orders the rows. Blocks of 2^20 consecutive positions are windowed independently; their
totals are windowed in super-blocks of 2^20 blocks, and those totals once more. No window ever
holds more than 2^23 rows, whatever the table's size, so nothing passes through one task.
`seq` must be non-negative and unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetable.plans.checkpoints import new_folder, through_table

BLOCK_BITS = 20

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}


def _combine(op: str, a: Column, b: Column) -> Column:
    """Merge of two partial results, either of which may be NULL (nothing seen)."""
    if op in ("sum", "count"):
        return F.coalesce(a + b, a, b)
    return F.greatest(a, b) if op == "max" else F.least(a, b)


def _offsets(totals: DataFrame, key: str, specs: dict, levels: int, bits: int) -> DataFrame:
    """Per block the merge of all earlier blocks."""
    ahead = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return totals.select(key, *[_MERGE[op](n).over(ahead).alias(n) for n, (op, _) in specs.items()])
    group = F.shiftright(F.col(key), bits)
    local = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.withColumn("_g", group).select(
        key, "_g", *[_MERGE[op](n).over(local).alias(n) for n, (op, _) in specs.items()]
    )
    sums = totals.groupBy(group.alias("_b")).agg(*[_MERGE[op](n).alias(n) for n, (op, _) in specs.items()])
    above = _offsets(sums, "_b", specs, levels - 1, bits).select(
        F.col("_b").alias("_g"), *[F.col(n).alias(f"_o_{n}") for n in specs]
    )
    return inside.join(above, "_g").select(
        key, *[_combine(op, F.col(f"_o_{n}"), F.col(n)).alias(n) for n, (op, _) in specs.items()]
    )


def prefix_scan(df: DataFrame, seq: str, specs: dict, inclusive: bool = True, bits: int = BLOCK_BITS) -> DataFrame:
    """Adds running columns. `specs` maps a name to (op, Column) with op sum, max, min or count.

    Exclusive scans give NULL where nothing precedes (0 for count).
    """
    block = F.shiftright(F.col(seq).cast("long"), bits)
    seeded = df.withColumns(
        {
            "_blk": block,
            **{f"_i_{n}": (c.isNotNull().cast("long") if op == "count" else c) for n, (op, c) in specs.items()},
        }
    )
    window = Window.partitionBy("_blk").orderBy(seq)
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = seeded.withColumns({f"_l_{n}": _MERGE[op](f"_i_{n}").over(frame) for n, (op, _) in specs.items()})
    # stored once: rows and block totals both come from it, so the input is read once and nested scans do not multiply it
    local = through_table(local, new_folder(df.sparkSession, "scan"))
    totals = local.groupBy("_blk").agg(*[_MERGE[op](f"_i_{n}").alias(n) for n, (op, _) in specs.items()])
    offsets = _offsets(totals, "_blk", specs, 1, bits).select("_blk", *[F.col(n).alias(f"_o_{n}") for n in specs])
    joined = local.join(offsets, "_blk")
    result = {}
    for n, (op, _) in specs.items():
        merged = _combine(op, F.col(f"_o_{n}"), F.col(f"_l_{n}"))
        result[n] = F.coalesce(merged, F.lit(0).cast("long")) if op == "count" else merged
    return joined.withColumns(result).select(*df.columns, *specs)


def ordered_table(df: DataFrame, order, name: str, start: int = 0, path: str | None = None) -> DataFrame:
    """Rows written in order with an increasing (not dense) position: partition number, then row in it.

    The table is stored in the checkpoint folder, so every later use sees the same positions.
    """
    ranked = df.orderBy(*order).withColumn(name, F.monotonically_increasing_id() + F.lit(start))
    return through_table(ranked, path or new_folder(df.sparkSession, "ordered"))


def number_rows(df: DataFrame, order, name: str = "rn", start: int = 0) -> DataFrame:
    """Dense global row numbers in the given (total) order: a distributed sort, then one offset per partition."""
    ordered = ordered_table(df, order, "_mid")
    part = F.shiftright("_mid", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = ordered.withColumn("_part", part).join(offsets, "_part")
    position = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_off") + F.lit(start)
    return numbered.select(*df.columns, position.cast("long").alias(name))


def _bin(key: Column, bounds: list[Column], lo: int, hi: int) -> Column:
    """2 i + 1 for a key that equals the i-th bound, 2 i for one below it and above the bound before, by bisection."""
    if lo == hi:
        return F.lit(2 * lo)
    mid = (lo + hi) // 2
    return (
        F.when(key < bounds[mid], _bin(key, bounds, lo, mid))
        .when(key == bounds[mid], F.lit(2 * mid + 1))
        .otherwise(_bin(key, bounds, mid + 1, hi))
    )


def _least(keys: DataFrame, order, k: int, bins: int, small: int):
    """The k-th (from 1) of the rows of `keys` in `order`, or None where there are fewer.

    Each round takes some keys of the range that holds the k-th as bounds and counts the range's rows at and between
    them. The range between two neighbouring bounds is the next round's; a range of at most `small` rows is left to a sort
    with a limit. A bound that equals the k-th ends the search, so ties do not prolong it.
    """
    key = F.struct(*order)
    literal = lambda row: F.struct(*[F.lit(row[c]).cast(keys.schema[c].dataType).alias(c) for c in order])
    rows, left, count = keys, k, keys.count()
    if count < k:
        return None
    turn = 0
    while count > small:
        # some 30 rows a bin on average, whatever the range's size
        drawn = rows.sample(min(1.0, 30 * bins / count), seed=turn).orderBy(*order).limit(60 * bins).collect()
        cut = drawn[:: max(len(drawn) // bins, 1)]
        bounds = [b for i, b in enumerate(cut) if not i or b != cut[i - 1]]
        turn += 1
        if not bounds:
            continue
        sizes = dict(rows.groupBy(_bin(key, [literal(b) for b in bounds], 0, len(bounds)).alias("b")).count().collect())
        hit, under = 0, 0
        while under + sizes.get(hit, 0) < left:
            under += sizes.get(hit, 0)
            hit += 1
        if hit % 2:
            return bounds[hit // 2]
        left, count = left - under, sizes[hit]
        if hit:
            rows = rows.where(key > literal(bounds[hit // 2 - 1]))
        if hit < 2 * len(bounds):
            rows = rows.where(key < literal(bounds[hit // 2]))
    return rows.orderBy(*order).limit(left).agg(F.max(key).alias("k")).first()["k"]


def first_rows(df: DataFrame, order, n: int, bins: int = 64, small: int = 100_000) -> DataFrame:
    """The first n rows in the given (total) order of columns; NULLs come first, and rows that equal the n-th stay.

    Nothing is sorted as a whole: the order columns are stored once, the n-th key is found by counting (`_least`), and
    it is a filter on the rows.
    """
    if n <= 0:
        return df.limit(0)
    keys = through_table(df.select(*order), new_folder(df.sparkSession, "keys"))
    nth = _least(keys, list(order), n, bins, small)
    if nth is None:
        return df
    last = F.struct(*[F.lit(nth[c]).cast(df.schema[c].dataType).alias(c) for c in order])
    return df.where(F.struct(*order) <= last)
