"""Extracted tables: append, update, delete, insert at a position, replace record lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.operators.joins import greatest_per_key, spread_join
from pagetable.operators.scan import number_rows


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; a column that one side lacks is NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


def update_records(records: DataFrame, values: DataFrame) -> DataFrame:
    """Non-NULL cells of `values` overwrite the known columns of all rows of their url; of several rows for a url the
    greatest counts."""
    cells = [c for c in values.columns if c != "url" and c in records.columns]
    joined = spread_join(records, greatest_per_key(values, "url", cells), "url")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cells else F.col(c) for c in records.columns]
    )


def remove_records(records: DataFrame, urls: DataFrame) -> DataFrame:
    return spread_join(records, urls.select("url").distinct(), "url", "left_anti")


def insert_at(records: DataFrame, position: int, rows: DataFrame, order: str = "ord") -> DataFrame:
    """Rows inserted before a 0-based position; both sides carry a dense order column from 0.

    Later rows move up by the number of inserted rows, so no re-ranking sort is needed.
    """
    n = rows.agg(F.count("*")).first()[0]
    shifted = records.withColumn(order, F.col(order) + F.when(F.col(order) >= position, F.lit(n)).otherwise(F.lit(0)))
    placed = rows.withColumn(order, F.col(order) + F.lit(position))
    return shifted.unionByName(placed, allowMissingColumns=True)


def replace_record_lists(records: DataFrame, changed: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """All rows of the changed urls go, the new rows come in."""
    gone = changed.select("url").distinct() if urls is None else urls
    return append(remove_records(records, gone), changed.select(*[c for c in changed.columns if c in records.columns]))


def renumber(records: DataFrame, order, name: str = "ord") -> DataFrame:
    """Dense order column after deletions."""
    kept = records.drop(name) if name in records.columns and name not in order else records
    if name in order:
        kept = records.withColumnRenamed(name, f"_{name}")
        order = [f"_{name}" if o == name else o for o in order]
        return number_rows(kept, order, name).drop(f"_{name}")
    return number_rows(kept, order, name)
