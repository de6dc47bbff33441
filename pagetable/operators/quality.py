"""Record gates: required fields and the minimum share of filled fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetable.functions.values import round_2sig


def _typed(schema: T.StructType, name: str, cell) -> tuple[Column, bool]:
    return cell(name), isinstance(schema[name].dataType, T.ArrayType)


def filled(value: Column, is_list: bool = False) -> Column:
    """Non-empty text or non-empty list; never NULL."""
    test = F.size(value) > 0 if is_list else value != ""
    return F.coalesce(test, F.lit(False))


def required_filled(schema: T.StructType, required, cell=F.col) -> Column:
    """All required fields filled; a field that is not in the schema never is."""
    out = F.lit(True)
    for name in required:
        out = out & (filled(*_typed(schema, name, cell)) if name in schema.names else F.lit(False))
    return out


def fill_ratio(schema: T.StructType, csv_cols, cell=F.col) -> Column:
    """Filled / present fields with two significant digits; NULL when no field is present."""
    if not csv_cols:
        return F.lit(None).cast("double")
    found = sum((cell(c).isNotNull().cast("int") for c in csv_cols), F.lit(0))
    full = sum((filled(*_typed(schema, c, cell)).cast("int") for c in csv_cols), F.lit(0))
    return F.when(found > 0, round_2sig(full.cast("double") / found))


def any_present(csv_cols, cell=F.col) -> Column:
    out = F.lit(False)
    for c in csv_cols:
        out = out | cell(c).isNotNull()
    return out


def passes_gate(schema: T.StructType, csv_cols, required=(), min_filled: float = -1.0, cell=F.col) -> Column:
    """A record without any present field never passes (its ratio counts as -666).

    `cell` reads a field by name: a column, or a field of a struct inside an array.
    """
    keep = required_filled(schema, required, cell)
    if min_filled <= 0:
        # the ratio of a present record is at least 0: only presence is left to test
        return keep & any_present(csv_cols, cell)
    return keep & (F.coalesce(fill_ratio(schema, csv_cols, cell), F.lit(-666.0)) >= F.lit(float(min_filled)))
