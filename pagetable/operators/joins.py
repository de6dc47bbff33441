"""Joins on a key that a large part of the left rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """`left` joined with `right` (at most one row per key) on `key`; rows of hot keys are spread.

    A plain equi-join, so that `left` is read once: if its size calls for a shuffle, adaptive execution cuts every
    partition that is much larger than the others into tasks of the advisory size and repeats its right rows, as many
    times as the partition's bytes ask for. All four join kinds used here (inner, left, semi, anti) allow that.
    """
    joined = left.join(right, key, how)
    names = left.columns if how in ("left_semi", "left_anti") else left.columns + [c for c in right.columns if c != key]
    return joined.select(*names)


def greatest_per_key(rows: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """One row per key with `cells` as _new_<cell>: that of the greatest row, so repeated keys multiply nothing."""
    if not cells:
        return rows.select(key).distinct()
    best = rows.groupBy(key).agg(F.max(F.struct(*cells)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(f"_new_{c}") for c in cells])
