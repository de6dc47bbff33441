"""A rule library as one DataFrame plan over pages.

    pages -> URL filter -> parse_dom -> distinct selectors -> conditions -> values -> records

Everything after `parse_dom` is row-local expressions: no shuffle. Selectors and conditions that
several rules share are computed once per page, and only on pages where a rule that needs them is
active. NULL means that a page has no such key, '' that the rule found nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetable.functions.regex import group_count
from pagetable.functions.urls import canonical_url, url_join
from pagetable.functions.values import py_strip
from pagetable.operators.conditions import (
    any_of,
    condition_holds,
    filter_matches,
    finds,
    first_true,
    page_precondition,
    url_active,
)
from pagetable.operators.dom import parse_dom, script_capture
from pagetable.operators.quality import passes_gate
from pagetable.operators.selectors import select
from pagetable.operators.shaping import (
    content_filter,
    has_gap,
    records_of,
    value_attr,
    value_text,
    values_attr,
    values_positional,
    values_text,
)
from pagetable.plans.library import Library, Rule

LINKS = "getLinks"


@dataclass(frozen=True)
class KeyValue:
    """What one rule says about one key: present where `present`, of kind scalar | list | records."""

    key: str
    rule_pos: int
    kind: str
    present: Column
    value: Column
    fields: tuple[str, ...] = ()


def any_rule_active(lib: Library, url="url") -> Column:
    if any(not r.url_patterns for r in lib.rules):
        return F.lit(True)
    patterns = dict.fromkeys(p for r in lib.rules for p in r.url_patterns)
    return any_of(finds(F.col(url) if isinstance(url, str) else url, p) for p in patterns)


def _page_selectors(rule: Rule) -> list[str]:
    """Selectors a rule evaluates on the whole page."""
    out = [c.css for c in rule.pre]
    if rule.target != "js":
        out.append(rule.css)
        if rule.pre_type.lower() == "any":
            out.extend(c.rule_css for c in rule.pre if c.rule_css)
    return out


class LibraryPlan:
    """Adds the working columns of a library to parsed pages, layer by layer."""

    def __init__(self, lib: Library):
        self.lib = lib
        users: dict[str, list[int]] = {}
        conditions: dict[tuple[str, str], None] = {}
        for i, rule in enumerate(lib.rules):
            for css in _page_selectors(rule):
                users.setdefault(css, []).append(i)
            for c in rule.pre:
                conditions.setdefault((c.css, c.regex), None)
        self.users = users
        self.selector_column = {css: f"_s{k}" for k, css in enumerate(users)}
        self.condition_column = {c: f"_c{k}" for k, c in enumerate(conditions)}

    def flags(self, rule: Rule) -> list[str]:
        return [self.condition_column[(c.css, c.regex)] for c in rule.pre]

    def matched(self, css: str) -> Column:
        return F.col(self.selector_column[css])

    def working_columns(self, parsed: DataFrame) -> DataFrame:
        """+ _u<i> rule active, _s<k> matches, _c<k> conditions, _p<i> preconditions, _m<i> final matches."""
        lib = self.lib
        out = parsed.withColumns({f"_u{i}": url_active(r) for i, r in enumerate(lib.rules)})
        found = {}
        for css, column in self.selector_column.items():
            if css.strip() and all(lib.rules[i].url_patterns for i in self.users[css]):
                used = any_of(F.col(f"_u{i}") for i in dict.fromkeys(self.users[css]))
                found[column] = F.when(used, select(css))
            elif css.strip():
                found[column] = select(css)
            else:
                found[column] = F.filter("dom", lambda n: F.lit(False))
        if found:
            out = out.withColumns(found)
        holds = {
            column: F.coalesce(condition_holds(self.matched(css), regex), F.lit(False))
            for (css, regex), column in self.condition_column.items()
        }
        if holds:
            out = out.withColumns(holds)
        out = out.withColumns(
            {f"_p{i}": F.when(F.col(f"_u{i}"), page_precondition(r, self.flags(r))) for i, r in enumerate(lib.rules)}
        )
        final = {}
        for i, r in enumerate(lib.rules):
            if r.target == "js":
                continue
            base = self.matched(r.css)
            if r.pre_type.lower() == "any" and any(c.rule_css for c in r.pre):
                base = first_true(
                    [F.col(f) for f in self.flags(r)],
                    [self.matched(c.rule_css) if c.rule_css else base for c in r.pre],
                    base,
                )
            final[f"_m{i}"] = F.when(F.col(f"_p{i}"), filter_matches(base, r))
        return out.withColumns(final) if final else out

    def key_values(self) -> list[KeyValue]:
        return [kv for i, r in enumerate(self.lib.rules) for kv in self._rule_values(i, r)]

    def _rule_values(self, i: int, r: Rule) -> list[KeyValue]:
        failed = F.coalesce(~F.col(f"_p{i}"), F.lit(False))
        applied = F.coalesce(F.col(f"_p{i}"), F.lit(False))
        blank, empty = F.lit(""), F.array().cast("array<string>")

        def scalar(value: Column, ran: Column | None = None) -> KeyValue:
            ran = applied & value.isNotNull() if ran is None else ran
            return KeyValue(r.name, i, "scalar", failed | ran, F.when(failed, blank).when(applied, value))

        def listing(value: Column, ran: Column) -> KeyValue:
            return KeyValue(r.name, i, "list", failed | ran, F.when(failed, empty).when(ran, value))

        if r.shape == "script":
            return [scalar(self._script_value(r))]
        m = F.col(f"_m{i}")
        if r.shape == "text":
            return [scalar(value_text(content_filter(m, r.content_regex), r.match_pos, r.remove))]
        if r.shape == "attr":
            if r.match_pos < 0:
                return [listing(values_attr(m, r.attr), applied)]
            none = F.size(m) == 0
            # an element without the attribute is a present key without a value
            ran = applied & (none | F.try_element_at(m, F.lit(r.match_pos + 1)).isNotNull())
            value = value_attr(m, r.attr, r.match_pos)
            if r.returns_more:
                return [listing(F.when(none, empty).otherwise(F.array(value)), ran)]
            return [scalar(F.when(none, blank).otherwise(value), ran)]
        # list modes: a replaced match that is missing makes the content test and the named modes fail
        sound = applied & ~has_gap(m) if _may_have_gaps(r) else applied
        kept = content_filter(m, r.content_regex)
        if r.shape == "texts":
            return [listing(values_text(kept, r.remove), sound if r.content_regex else applied)]
        if r.shape == "named":
            if _may_have_gaps(r) and not r.content_regex:
                # only as many matches as there are names are read
                sound = applied & ~has_gap(F.slice(m, 1, len(r.value_names)))
            out = []
            for name, value in values_positional(kept, r.value_names, r.remove).items():
                out.append(KeyValue(name, i, "scalar", sound & value.isNotNull(), F.when(sound, value)))
            # a failed precondition leaves '' under the rule's own name
            return out + [KeyValue(r.name, i, "scalar", failed, F.when(failed, blank))]
        fields = r.record_fields
        if not fields:
            return [listing(empty, sound)]
        value = F.when(sound, records_of(kept, fields, r.remove))
        return [
            KeyValue(r.name, i, "records", sound, value, tuple(n for n, _ in fields)),
            KeyValue(r.name, i, "scalar", failed, F.when(failed, blank)),
        ]

    def _script_value(self, r: Rule) -> Column:
        def capture(pattern):
            if group_count(pattern) < 1:
                return F.lit(None).cast("string")
            return script_capture(pattern)

        base = capture(r.content_regex)
        if r.pre_type.lower() == "any" and any(c.rule_css for c in r.pre):
            return first_true(
                [F.col(f) for f in self.flags(r)],
                [capture(c.rule_css) if c.rule_css else base for c in r.pre],
                base,
            )
        return base


def _may_have_gaps(r: Rule) -> bool:
    return any(c.rule_css for c in r.match_pre)


def _latest(entries: list[KeyValue]) -> list[tuple[KeyValue, Column]]:
    """Entries of one key, last rule first, each with 'present and not overwritten'."""
    out, later = [], None
    for kv in sorted(entries, key=lambda e: -e.rule_pos):
        live = kv.present if later is None else kv.present & ~later
        out.append((kv, live))
        later = kv.present if later is None else later | kv.present
    return out


def _as_list(kv: KeyValue, stripped: bool) -> Column:
    """A scalar in a column that other rules fill with lists: one element, none if blank."""
    if kv.kind == "list":
        return kv.value
    text = py_strip(kv.value) if stripped else kv.value
    return F.when(kv.value.isNull(), F.lit(None)).otherwise(F.filter(F.array(text), lambda t: t != ""))


def _page_value(entries: list[KeyValue], stripped: bool) -> Column | None:
    """The page-level value of a key: STRING, or ARRAY<STRING> if any rule yields a list."""
    plain = [(kv, live) for kv, live in _latest(entries) if kv.kind != "records"]
    if not plain:
        return None
    as_list = any(kv.kind == "list" for kv, _ in plain)
    out = None
    for kv, live in plain:
        if as_list:
            value = _as_list(kv, stripped)
        else:
            value = py_strip(kv.value) if stripped else kv.value
        if len(entries) == 1:
            return value  # NULL exactly where the key is absent
        out = F.when(live, value) if out is None else out.when(live, value)
    return out


def parse_active(pages: DataFrame, lib: Library) -> DataFrame:
    """Pages on which some rule is active, parsed; the URL test runs below the parse."""
    keep = [c for c in pages.columns if c != "html"]
    active = any_rule_active(lib)
    narrowed = pages.select(*keep, "html").where(active)
    return parse_dom(narrowed)


def _passed(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c not in ("html", "dom", "chunks")]


def _parsed(pages: DataFrame, lib: Library) -> DataFrame:
    return pages if "dom" in pages.columns else parse_active(pages, lib)


def apply_library(pages: DataFrame, lib: Library) -> DataFrame:
    """Page columns plus one column per key (later rules win): STRING, ARRAY<STRING> or ARRAY<STRUCT>."""
    plan = LibraryPlan(lib)
    work = plan.working_columns(_parsed(pages, lib))
    by_key: dict[str, list[KeyValue]] = {}
    for kv in plan.key_values():
        by_key.setdefault(kv.key, []).append(kv)
    out = []
    for key, entries in by_key.items():
        lists = [(kv, live) for kv, live in _latest(entries) if kv.kind == "records"]
        if lists:
            out.append(reduce(lambda acc, e: acc.when(e[1], e[0].value), lists[1:], F.when(lists[0][1], lists[0][0].value)).alias(key))
        else:
            out.append(_page_value(entries, stripped=False).alias(key))
    return work.select(*_passed(pages), *out)


def apply_rule(pages: DataFrame, lib: Library, name: str) -> DataFrame:
    return apply_library(pages, lib.only(name))


def _tidy(kv: KeyValue, lib: Library) -> Column:
    rule = lib.rules[kv.rule_pos].name
    if kv.kind == "records":
        texts = F.transform(kv.value, lambda record: F.to_json(record))
    else:
        texts = kv.value if kv.kind == "list" else F.array(kv.value)
    return F.transform(
        texts,
        lambda text, pos: F.struct(
            F.lit(rule).alias("rule"),
            F.lit(kv.key).alias("key"),
            F.lit(kv.kind).alias("kind"),
            pos.cast("int").alias("pos"),
            text.alias("value"),
        ),
    )


def preview(pages: DataFrame, lib: Library, rule: str | None = None) -> DataFrame:
    """Tidy view of what the rules give: (page columns, rule, key, kind, pos, value).

    One row per scalar, list element or record (as JSON); an empty list gives no row.
    """
    chosen = lib.only(rule) if rule else lib
    plan = LibraryPlan(chosen)
    work = plan.working_columns(_parsed(pages, chosen))
    by_key: dict[str, list[KeyValue]] = {}
    for kv in plan.key_values():
        by_key.setdefault(kv.key, []).append(kv)
    items = [F.when(live, _tidy(kv, chosen)) for entries in by_key.values() for kv, live in _latest(entries)]
    rows = F.flatten(F.array_compact(F.array(*items)))
    return work.select(*_passed(pages), F.inline_outer(rows)).where(F.col("value").isNotNull())


def _csv_kinds(lib: Library, entries: list[KeyValue]) -> dict[str, bool]:
    """Output column -> is it a list column?"""
    return {
        c: any(kv.key == c and kv.kind == "list" for kv in entries) for c in lib.csv_cols
    }


def check_library(lib: Library) -> None:
    """Two record-list rules that are always active together cannot share a page."""
    always = [r.name for r in lib.rules if r.shape == "records" and not r.url_patterns and not r.pre and r.record_fields]
    if len(set(always)) > 1:
        raise ValueError(f"rules {always} give record lists on the same page")


def page_rows(pages: DataFrame, lib: Library, attach_scalars: bool = False, extra=None) -> DataFrame:
    """Page columns plus `_rows` ARRAY<STRUCT<csv columns>>: the page's record list if some rule gives a
    non-empty one (first such rule), else its single record. `extra` adds columns built from key values."""
    check_library(lib)
    plan = LibraryPlan(lib)
    work = plan.working_columns(_parsed(pages, lib))
    entries = plan.key_values()
    is_list = _csv_kinds(lib, entries)
    by_key: dict[str, list[KeyValue]] = {}
    for kv in entries:
        by_key.setdefault(kv.key, []).append(kv)

    def null_of(c):
        return F.lit(None).cast("array<string>" if is_list[c] else "string")

    scalars = {}
    for c in lib.csv_cols:
        value = _page_value(by_key[c], stripped=True) if c in by_key else None
        scalars[c] = null_of(c) if value is None else value
    record_entries = sorted(
        ((kv, live) for es in by_key.values() for kv, live in _latest(es) if kv.kind == "records"),
        key=lambda e: e[0].rule_pos,
    )
    record_columns = {f"_r{k}": F.when(live, kv.value) for k, (kv, live) in enumerate(record_entries)}
    extras = extra(by_key) if extra else {}
    work = work.select(
        *_passed(pages),
        *[scalars[c].alias(f"_v{i}") for i, c in enumerate(lib.csv_cols)],
        *[v.alias(k) for k, v in {**record_columns, **extras}.items()],
    )
    scalars = {c: F.col(f"_v{i}") for i, c in enumerate(lib.csv_cols)}
    single = F.array(F.struct(*[scalars[c].alias(c) for c in lib.csv_cols])) if lib.csv_cols else None

    def shaped(kv, column):
        def row(rec):
            cells = []
            for c in lib.csv_cols:
                if c in kv.fields:
                    text = py_strip(rec[c])
                    cell = F.filter(F.array(text), lambda t: t != "") if is_list[c] else text
                else:
                    cell = scalars[c] if attach_scalars else null_of(c)
                cells.append(cell.alias(c))
            return F.struct(*cells)

        return F.transform(F.col(column), row)

    rows, n_lists = single, F.lit(0)
    if single is not None:
        for (kv, _), column in reversed(list(zip(record_entries, record_columns))):
            has = F.coalesce(F.size(F.col(column)) > 0, F.lit(False))
            rows = F.when(has, shaped(kv, column)).otherwise(rows)
            n_lists = n_lists + has.cast("int")
    rows = F.array() if rows is None else rows
    return work.select(
        *_passed(pages), *extras, rows.alias("_rows"), (n_lists > 0).alias("_is_list"), n_lists.alias("_n_lists")
    )


def flatten_records(rows: DataFrame, lib: Library, keep=("url",)) -> DataFrame:
    """One row per record of `_rows`."""
    return rows.select(*keep, F.inline_outer("_rows"))


def stamp(records: DataFrame, accessed_at=None) -> DataFrame:
    """`dateaccessed` first; a parameter, so that a run can be repeated."""
    at = F.current_timestamp() if accessed_at is None else F.lit(accessed_at).cast("timestamp")
    return records.select(at.alias("dateaccessed"), *records.columns)


def extract(
    pages: DataFrame,
    lib: Library,
    accessed_at=None,
    gate: bool = True,
    attach_scalars: bool = False,
    keep=("url",),
) -> DataFrame:
    """Pages to records: (dateaccessed, url, csv columns). Shuffle-free; works on streams as well."""
    narrow = pages if "dom" in pages.columns else pages.select(*dict.fromkeys(("url", *keep, "html")))
    rows = flatten_records(page_rows(narrow, lib, attach_scalars), lib, keep)
    required, minimum = (lib.required, lib.min_filled) if gate else ((), -1.0)
    passed = rows.where(passes_gate(rows.schema, lib.csv_cols, required, minimum))
    return stamp(passed, accessed_at)


def record_list_conflicts(pages: DataFrame, lib: Library) -> DataFrame:
    """Pages on which more than one rule gave a record list (the first one was used)."""
    return page_rows(pages, lib).where("_n_lists > 1").select("url", F.col("_n_lists").alias("n_lists"))


def classify(pages: DataFrame, lib: Library) -> DataFrame:
    """(page columns, is_record_list) per page with an active rule."""
    rows = page_rows(pages, lib)
    return rows.select(*_passed(pages), F.col("_is_list").alias("is_record_list"))


def href_array(entries: list[KeyValue]) -> Column:
    """Raw link targets of a page in page order; NULLs and `#...` are dropped."""
    hrefs = None
    for kv, live in _latest([kv for kv in entries if kv.kind != "records"]):
        one = F.filter(F.array(kv.value), lambda h: h != "")
        value = kv.value if kv.kind == "list" else one
        hrefs = F.when(live, value) if hrefs is None else hrefs.when(live, value)
    return F.filter(hrefs, lambda h: h.isNotNull() & ~h.startswith("#"))


def link_array(entries: list[KeyValue], pattern: str, url="url") -> Column:
    """Canonical absolute URLs of a page's links that have the pattern, in page order."""
    base = F.col(url) if isinstance(url, str) else url
    absolute = F.transform(href_array(entries), lambda h: url_join(base, h))
    links = F.transform(absolute, canonical_url)
    return F.filter(links, lambda u: finds(u, pattern)) if pattern else links


def resolve_links(hrefs: DataFrame, lib: Library) -> DataFrame:
    """(src_url, pos, href) rows to edges (src_url, dst_url, pos), canonical and filtered."""
    absolute = hrefs.withColumn("_abs", url_join("src_url", "href"))
    edges = absolute.select("src_url", canonical_url("_abs").alias("dst_url"), "pos")
    pattern = lib.rule(LINKS).content_regex
    return edges.where(finds(F.col("dst_url"), pattern)) if pattern else edges


def extract_links(pages: DataFrame, lib: Library) -> DataFrame:
    """Link edges (src_url, dst_url, pos): pos is the link's place among the links of its page."""
    links_only = Library(rules=tuple(r for r in lib.rules if r.name == LINKS))
    if not links_only.rules:
        raise KeyError(f"the library has no rule named {LINKS!r}")
    plan = LibraryPlan(links_only)
    narrow = pages if "dom" in pages.columns else pages.select("url", "html")
    work = plan.working_columns(_parsed(narrow, links_only))
    hrefs = href_array([kv for kv in plan.key_values() if kv.key == LINKS])
    exploded = work.select(F.col("url").alias("src_url"), F.posexplode_outer(hrefs).alias("pos", "href"))
    return resolve_links(exploded.where(F.col("href").isNotNull()), lib)


def active_rules(pages: DataFrame, lib: Library) -> DataFrame:
    """(page columns, rule_pos, rule_name) for every rule whose URL patterns hit; no join."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(url_active(r), F.struct(F.lit(i).alias("rule_pos"), F.lit(r.name).alias("rule_name")))
                for i, r in enumerate(lib.rules)
            ]
        )
    )
    keep = _passed(pages)
    return pages.select(*keep, F.inline_outer(hits)).where(F.col("rule_pos").isNotNull())
