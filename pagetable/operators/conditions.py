"""URL activation, page conditions and match conditions as boolean Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetable.functions.regex import java_regex
from pagetable.operators.dom import text_of
from pagetable.operators.selectors import finding, let, select
from pagetable.plans.library import Condition, Rule


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def finds(text: Column, pattern: str) -> Column:
    """`re.search(pattern, text)` as a never-NULL boolean."""
    return F.coalesce(text.rlike(java_regex(pattern)), F.lit(False))


def any_of(flags) -> Column:
    out = None
    for f in flags:
        out = f if out is None else out | f
    return F.lit(False) if out is None else out


def all_of(flags) -> Column:
    out = None
    for f in flags:
        out = f if out is None else out & f
    return F.lit(True) if out is None else out


def url_active(rule: Rule, url="url") -> Column:
    """A rule without patterns is active on every URL."""
    if not rule.url_patterns:
        return F.lit(True)
    return any_of(finds(_c(url), p) for p in rule.url_patterns)


def condition_holds(matches: Column, regex: str, chunks="chunks") -> Column:
    """Something matched and, if a pattern is given, the first match's text has it."""
    found = F.size(matches) > 0
    if not regex.strip():
        return found
    return found & finds(text_of(F.get(matches, F.lit(0)), chunks), regex)


def holds_on_page(cond: Condition, dom="dom", chunks="chunks") -> Column:
    return condition_holds(select(cond.css, dom), cond.regex, chunks)


def holds_in_match(cond: Condition, node: Column, find, chunks="chunks") -> Column:
    """`find` as `selectors.finding` gives it."""
    first = find(node, cond.css)
    if not cond.regex.strip():
        return first.isNotNull()
    return let(first, lambda sub: sub.isNotNull() & finds(text_of(sub, chunks), cond.regex))


_WORD = re.compile(r"\s*(\(|\)|[^\s()]+)")


def eval_expression(expr: str, flag_columns: dict[str, str]) -> Column:
    """Boolean text over condition names -> Column; an unreadable text is false.

    `flag_columns` maps condition names to boolean column names. Only these names, and/or/not,
    parentheses and true/false are let through, and Spark's own parser reads the result.
    """
    columns = {}
    for name, column in flag_columns.items():
        columns.setdefault(name.lower(), f"`{column}`")
    out = []
    for w in _WORD.findall(expr.strip().lower()):
        if w not in ("(", ")", "and", "or", "not", "true", "false"):
            if w not in columns:
                return F.lit(False)
            w = columns[w]
        out.append(w)
    return F.expr(" ".join(out)) if _well_formed(out) else F.lit(False)


def _well_formed(words: list[str]) -> bool:
    """Operands and operators alternate and parentheses close."""
    depth, want_operand = 0, True
    for w in words:
        if w == "(" or w == "not":
            if not want_operand:
                return False
            depth += w == "("
        elif w in ("and", "or"):
            if want_operand:
                return False
            want_operand = True
        elif w == ")":
            if want_operand or depth == 0:
                return False
            depth -= 1
        else:
            if not want_operand:
                return False
            want_operand = False
    return depth == 0 and not want_operand


def page_precondition(rule: Rule, flag_names: list[str]) -> Column:
    """Do the page preconditions hold, given one boolean column per condition?

    NULL means that the rule is skipped (EVAL without an expression).
    """
    flags = [F.col(f) for f in flag_names]
    if not rule.pre:
        return F.lit(True)
    mode = rule.pre_type.lower()
    if mode == "any":
        return any_of(flags)
    if mode == "all":
        return all_of(flags)
    if mode == "eval":
        if not rule.pre_expr.strip():
            return F.lit(None).cast("boolean")
        named = {}
        for cond, flag in zip(rule.pre, flag_names):
            if cond.name.strip():
                named.setdefault(cond.name, flag)
        return eval_expression(rule.pre_expr, named)
    return F.lit(False)


def first_true(flags: list[Column], values: list, default) -> Column:
    """CASE over flags; used for selector overrides under ANY."""
    out = None
    for f, v in zip(flags, values):
        out = F.when(f, v) if out is None else out.when(f, v)
    return default if out is None else out.otherwise(default)


def filter_matches(matches: Column, rule: Rule, dom="dom", chunks="chunks") -> Column:
    """Match preconditions: keep elements where one holds; a replacement selector swaps the element
    for its first sub-match (NULL when there is none)."""
    if not rule.match_pre:
        return matches
    return let(matches, lambda found: _chosen(found, rule, dom, chunks))


def _chosen(matches: Column, rule: Rule, dom, chunks) -> Column:
    used = [c.css for c in rule.match_pre]
    swaps = [c.rule_css for c in rule.match_pre]

    def kept(find):
        return F.filter(matches, lambda m: any_of(holds_in_match(c, m, find, chunks) for c in rule.match_pre))

    if not any(swaps):
        return finding(used, dom, kept, matches)
    if len(set(swaps)) == 1:
        return finding([*used, swaps[0]], dom, lambda find: F.transform(kept(find), lambda m: find(m, swaps[0])), matches)

    def swapped(m, find):
        holds = [holds_in_match(c, m, find, chunks) for c in rule.match_pre]
        return first_true(holds, [find(m, css) if css else m for css in swaps], m)

    return finding([*used, *filter(None, swaps)], dom, lambda find: F.transform(kept(find), lambda m: swapped(m, find)), matches)
