"""Matches to values: single texts, lists, named positions, record lists, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetable.functions.values import remove_chars
from pagetable.operators.conditions import finds
from pagetable.operators.dom import attr_of, text_of
from pagetable.operators.selectors import finding, let


def has_gap(matches: Column) -> Column:
    """A match replacement found nothing somewhere in the array."""
    return F.exists(matches, lambda m: m.isNull())


def content_filter(matches: Column, regex: str, chunks="chunks") -> Column:
    if not regex:
        return matches
    return F.filter(matches, lambda m: m.isNotNull() & finds(text_of(m, chunks), regex))


def nth_match(values: Column, pos: int) -> Column:
    """0-based from the start, negative from the end; NULL when out of range."""
    return F.try_element_at(values, F.lit(pos + 1 if pos >= 0 else pos))


def value_text(matches: Column, pos: int = -1, remove=(), chunks="chunks") -> Column:
    """'' without any match, NULL when the position is out of range."""
    node = nth_match(matches, pos)
    text = F.when(node.isNotNull(), remove_chars(text_of(node, chunks), remove))
    return F.when(F.size(matches) == 0, F.lit("")).otherwise(text)


def values_text(matches: Column, remove=(), chunks="chunks") -> Column:
    present = F.filter(matches, lambda m: m.isNotNull())
    return F.transform(present, lambda m: remove_chars(text_of(m, chunks), remove))


def values_positional(matches: Column, names, remove=(), chunks="chunks") -> dict[str, Column]:
    """i-th match under the i-th name; NULL for names without a match."""
    out = {}
    for i, name in enumerate(names):
        node = nth_match(matches, i)
        out[name] = F.when(node.isNotNull(), remove_chars(text_of(node, chunks), remove))
    return out


def records_of(matches: Column, fields, remove=(), dom="dom", chunks="chunks") -> Column:
    """ARRAY<STRUCT>: per match the text of each field's first sub-match, '' if there is none."""

    def cell(sub):
        text = remove_chars(text_of(sub, chunks), remove, per_character=True)
        return F.when(sub.isNotNull(), text).otherwise(F.lit(""))

    def record(m, find):
        return F.struct(*[let(find(m, css), cell).alias(name) for name, css in fields])

    used = [css for _, css in fields]

    def records(found):
        return finding(used, dom, lambda find: F.transform(found, lambda m: record(m, find)), found)

    return let(matches, records)


def value_attr(matches: Column, attr: str, pos: int) -> Column:
    node = nth_match(matches, pos)
    return F.when(node.isNotNull(), attr_of(node, attr))


def values_attr(matches: Column, attr: str) -> Column:
    present = F.filter(matches, lambda m: m.isNotNull())
    return F.transform(present, lambda m: attr_of(m, attr))
