"""Page source to DOM column: the one Python step, an Arrow pass without shuffle.

`parse_dom` replaces the `html` column by

* `dom`    ARRAY<NODE>    one entry per element in document order, and
* `chunks` ARRAY<STRING>  the page's text pieces; an element's text is the range [c0, c1).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetable.functions.regex import java_regex
from pagetable.operators.markup import parse_batches
from pagetable.schemas import NODE


def parse_dom(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every other column of `pages` plus `dom` and `chunks`; the source text goes no further."""
    fields = [f for f in pages.schema.fields if f.name != html]
    kept = [f.name for f in fields]
    schema = T.StructType(
        fields
        + [
            T.StructField("dom", T.ArrayType(NODE)),
            T.StructField("chunks", T.ArrayType(T.StringType())),
        ]
    )
    return pages.mapInArrow(lambda batches: parse_batches(batches, html, kept), schema)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_of(node: Column, chunks="chunks") -> Column:
    """Text of an element: inner white space collapsed, one line per block, trimmed."""
    pieces = _c(chunks)
    first, stop = node["c0"], node["c1"]
    joined = F.array_join(F.transform(F.sequence(first, stop - 1), lambda i: F.get(pieces, i)), "")
    raw = F.when(stop <= first, F.lit("")).when(stop == first + 1, F.get(pieces, first)).otherwise(joined)
    return F.btrim(
        F.regexp_replace(F.regexp_replace(raw, "[ \\n]*\\n[ \\n]*", "\n"), " {2,}", " "), F.lit(" \n")
    )


def attr_of(node: Column, name: str) -> Column:
    """Attribute value or NULL."""
    return F.try_element_at(node["attrs"], F.lit(name.lower()))


def script_capture(pattern: str, group: int = 1, dom="dom", chunks="chunks") -> Column:
    """Group of the first match over the page's scripts, in order; NULL if no script matches."""
    rx = java_regex(pattern, multiline=True)
    pieces = _c(chunks)
    bodies = F.transform(F.filter(_c(dom), lambda n: n["tag"] == "script"), lambda n: F.get(pieces, n["c0"]))
    hits = F.filter(bodies, lambda b: b.rlike(rx))
    return F.regexp_extract(F.try_element_at(hits, F.lit(1)), rx, group)


def visible_text(dom="dom", chunks="chunks") -> Column:
    """Text a reader sees: no head, title, style or script; pieces trimmed and joined by one space."""
    pieces, end = _c(chunks), F.struct(F.size(_c(chunks)).alias("c0"), F.lit(0).alias("c1"))
    unseen = F.transform(F.filter(_c(dom), lambda n: n["unseen"]), lambda n: F.struct(n["c0"].alias("c0"), n["c1"].alias("c1")))

    def between(gaps):
        # the gaps are disjoint and in order: what lies between two of them is shown
        def part(g, i):
            start = F.coalesce(F.get(gaps, i - 1)["c1"], F.lit(0))
            return F.slice(pieces, start + 1, F.greatest(g["c0"] - start, F.lit(0)))

        return F.flatten(F.transform(gaps, part))

    shown = F.get(F.transform(F.array(F.array_sort(F.concat(unseen, F.array(end)))), between), F.lit(0))
    trimmed = F.transform(shown, lambda t: F.btrim(t, F.lit(" \n")))
    return F.array_join(F.filter(trimmed, lambda t: t != ""), " ")
