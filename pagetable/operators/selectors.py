"""CSS selectors as Columns over the DOM array.

A selector string becomes one boolean expression per element, built from native higher-order
functions: row-local, no shuffle, no Python at run time. Supported: type, `*`, `#id`, `.class`,
`[attr]` and `[attr op value]`, the combinators ` `, `>`, `+`, `~`, `:nth-child(an+b)`,
`:first-child`, `:last-child`, `:not(...)` and selector lists.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetable.operators.dom import text_of

_NAME = r"(?:[-\w]|[^\x00-\x7f]|\\.)+"
_SIMPLE = re.compile(
    rf"(?P<type>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


class SelectorError(ValueError):
    pass


def _either(flags) -> Column:
    return reduce(or_, flags)


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _split_list(css: str) -> list[str]:
    """Split at commas outside brackets, parentheses and quotes."""
    parts = re.findall(r"(?:[^,\[\](\"']|\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|\"[^\"]*\"|'[^']*')+", css)
    if len(css) != len(",".join(parts)) or not all(p.strip() for p in parts):
        raise SelectorError(f"cannot read selector list {css!r}")
    return [p.strip() for p in parts]


@lru_cache(maxsize=4096)
def _steps(css: str) -> tuple:
    """One complex selector as ((combinator to the left, simple tests), ...), rightmost first."""
    css, pos, out, comb = css.strip(), 0, [], ""
    while pos < len(css):
        tests = []
        while pos < len(css) and (m := _SIMPLE.match(css, pos)):
            tests.append({k: v for k, v in m.groupdict().items() if v is not None})
            pos = m.end()
        if not tests:
            raise SelectorError(f"cannot read selector {css!r} at {pos}")
        out.append((comb, tuple(tests)))
        m = _COMBINATOR.match(css, pos)
        if m:
            comb, pos = m[1] or " ", m.end()
            if pos == len(css):
                raise SelectorError(f"selector {css!r} ends with a combinator")
        elif pos < len(css):
            raise SelectorError(f"cannot read selector {css!r} at {pos}")
    if not out:
        raise SelectorError("empty selector")
    return tuple(reversed(out))


def _nth(arg: str):
    arg = arg.replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not m:
        raise SelectorError(f"cannot read position {arg!r}")
    if m[3] is not None:
        return 0, int(m[3])
    step = {"": 1, "+": 1, "-": -1}.get(m[1])
    return (int(m[1]) if step is None else step), int(m[2] or 0)


def _test(t: dict, n: Column, page: _Page) -> Column | None:
    if "type" in t:
        return None if t["type"] == "*" else n["tag"] == _plain(t["type"]).lower()
    if "id" in t:
        return n["id"].eqNullSafe(F.lit(_plain(t["id"])))
    if "cls" in t:
        return F.array_contains(n["classes"], _plain(t["cls"]))
    if "attr" in t:
        name = _plain(t["attr"]).lower()
        if "op" not in t:
            return F.map_contains_key(n["attrs"], name)
        want = t.get("dq", t.get("sq", t.get("bare", "")))
        got = F.coalesce(F.try_element_at(n["attrs"], F.lit(name)), F.lit(""))
        present = F.map_contains_key(n["attrs"], name)
        if t["op"] == "=":
            return present & (got == want)
        if t["op"] == "|=":
            return present & ((got == want) | got.startswith(want + "-"))
        if want == "" or (t["op"] == "~=" and re.search(r"\s", want)):
            return F.lit(False)
        if t["op"] == "~=":
            return F.array_contains(F.split(got, r"\s+"), want)
        return {"^=": got.startswith, "$=": got.endswith, "*=": got.contains}[t["op"]](F.lit(want))
    pseudo, arg = t["pseudo"], t.get("arg", "")
    if pseudo == "nth-child":
        a, b = _nth(arg)
        if a == 0:
            return n["nth"] == b
        k = n["nth"] - b
        return (k % abs(a) == 0) & (k * (1 if a > 0 else -1) >= 0)
    if pseudo == "first-child":
        return n["nth"] == 1
    if pseudo == "last-child":
        return ~F.coalesce(F.get(page.dom, n["sub_end"] + 1)["parent"] == n["parent"], F.lit(False))
    if pseudo == "not":
        if arg in page.nots:
            return ~page.reached(page.nots[arg], n["idx"])
        return ~_either(_compound(steps[0][1], n, page) for steps in _chains(arg))
    raise SelectorError(f"unsupported pseudo-class :{pseudo}")


def _compound(tests, n: Column, page: _Page) -> Column:
    checks = [c for c in (_test(t, n, page) for t in tests) if c is not None]
    if not checks:
        return F.lit(True)
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def _chains(css: str) -> list[tuple]:
    chains = [_steps(part) for part in _split_list(css)]
    if not chains:
        raise SelectorError("empty selector")
    return chains


def _linked_nots(css: str) -> list[str]:
    """The arguments of `:not()` in a selector that have combinators, inner ones first."""
    found = []
    for steps in _chains(css):
        for t in (t for _, tests in steps for t in tests if t.get("pseudo") == "not"):
            inner = _linked_nots(t.get("arg", ""))
            if inner or any(len(s) > 1 for s in _chains(t.get("arg", ""))):
                found += [*inner, t.get("arg", "")]
    return list(dict.fromkeys(found))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once: inside a lambda a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class _Page:
    """The elements that a selector looks at: the whole page, or what lies from place `first` on as if nothing were before it.

    `nots` holds, for arguments of `:not()` with combinators, the result of `_nearest` on the same elements.
    """

    def __init__(self, dom: Column, elements: Column | None = None, first: Column | None = None, nots=None):
        self.dom, self.elements, self.first, self.nots = dom, dom if elements is None else elements, first, nots or {}

    def place(self, idx: Column) -> Column:
        return idx if self.first is None else idx - self.first

    def reached(self, nearest: Column, idx: Column) -> Column:
        return F.coalesce(F.get(nearest, self.place(idx)) >= 0, F.lit(False))

    def knowing(self, css: str, use) -> Column:
        """`use(page)` with the linked `:not()` arguments of `css` computed before."""
        missing = [arg for arg in _linked_nots(css) if arg not in self.nots]
        if not missing:
            return use(self)

        def bound(value):
            return _Page(self.dom, self.elements, self.first, {**self.nots, missing[0]: value}).knowing(css, use)

        return let(_nearest(missing[0], self), bound)


def _greatest_along(values: Column, page: _Page, link: str) -> Column:
    """Per element the greatest value at it or further along the link (parent or earlier sibling), by doubling."""

    def double(way, _):
        v, to = way["v"], way["to"]
        return F.struct(
            F.transform(v, lambda x, i: F.greatest(x, F.get(v, F.get(to, i)))).alias("v"),
            F.transform(to, lambda t: F.coalesce(F.get(to, t), F.lit(-1))).alias("to"),
        )

    start = F.struct(values.alias("v"), F.transform(page.elements, lambda n: page.place(n[link])).alias("to"))
    far = F.array_max(F.transform(page.elements, lambda n: n["depth"] if link == "parent" else n["nth"]))
    rounds = F.ceil(F.log2(F.coalesce(far, F.lit(1)) + 1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, double)["v"]


def _nearest_of(steps, page: _Page) -> Column:
    """Per element that matches the chain the place of its leftmost element, as near as possible; -1 for the others. So
    the element matches within a scope if that place is not before the scope. One pass over the page for each step."""
    if len(steps) == 1:
        return F.transform(page.elements, lambda n: F.when(_compound(steps[0][1], n, page), n["idx"]).otherwise(F.lit(-1)))
    comb, rest = steps[0][0], _nearest_of(steps[1:], page)
    link = "parent" if comb in " >" else "prev"
    if comb in " ~":
        rest = let(rest, lambda values: _greatest_along(values, page, link))

    def step(values):
        def here(n):
            beside = F.coalesce(F.get(values, page.place(n[link])), F.lit(-1))
            return F.when((beside >= 0) & _compound(steps[0][1], n, page), beside).otherwise(F.lit(-1))

        return F.transform(page.elements, here)

    return let(rest, step)


def _nearest(css: str, page: _Page) -> Column:
    """`_nearest_of` for a selector list: the nearest of all its chains."""
    told = [_nearest_of(steps, page) for steps in _chains(css)]
    out = told[0]
    for other in told[1:]:
        out = F.zip_with(out, other, lambda a, b: F.greatest(a, b))
    return out


def _matching(css: str, page: _Page) -> Column:
    """The elements that match, in document order."""
    if all(len(steps) == 1 for steps in _chains(css)):
        return F.filter(page.elements, lambda n: _either(_compound(steps[0][1], n, page) for steps in _chains(css)))
    return let(_nearest(css, page), lambda near: F.filter(page.elements, lambda n: page.reached(near, n["idx"])))


def select(css: str, dom="dom") -> Column:
    """ARRAY of the page's elements that match, in document order; time is linear in the page but for a logarithm."""
    return _Page(_c(dom)).knowing(css, lambda page: _matching(css, page))


def match_count(css: str, dom="dom") -> Column:
    return F.size(select(css, dom))


def _found(css: str, page: _Page) -> Column:
    """The page's matches for `_first_in`: their places, and the greatest `_nearest` place up to each, which only grows."""
    if all(len(steps) == 1 for steps in _chains(css)):
        places = F.transform(_matching(css, page), lambda n: n["idx"])
        return let(places, lambda at: F.struct(at.alias("at"), at.alias("top")))

    def found(near):
        start = F.lit(0) if page.first is None else page.first
        at = F.filter(F.transform(near, lambda x, i: F.when(x >= 0, i + start)), lambda i: i.isNotNull())
        top = F.filter(near, lambda x: x >= 0)

        def double(v, step):
            return F.transform(v, lambda x, i: F.greatest(x, F.get(v, i - F.pow(F.lit(2), step).cast("int"))))

        rounds = F.ceil(F.log2(F.size(top) + 1)).cast("int")
        return F.struct(at.alias("at"), F.aggregate(F.sequence(F.lit(0), rounds), top, double).alias("top"))

    return let(_nearest(css, page), found)


def _first_in(found: Column, first: Column, last: Column) -> Column:
    """The first place from `first` to `last` that matches with nothing before `first`, NULL if none: of the matches whose
    nearest chain starts in time the first one is where the greatest start so far reaches the scope (bisection)."""

    def halve(way, _):
        a, b = way["a"], way["b"]
        mid = F.floor((a + b) / 2).cast("int")
        late = F.get(found["top"], mid) >= first
        return F.when(a < b, F.struct(F.when(late, a).otherwise(mid + 1).alias("a"), F.when(late, mid).otherwise(b).alias("b"))).otherwise(way)

    size = F.size(found["top"])
    rounds = F.ceil(F.log2(size + 1)).cast("int")
    way = F.aggregate(F.sequence(F.lit(0), rounds), F.struct(F.lit(0).alias("a"), size.alias("b")), halve)
    return let(F.get(found["at"], way["a"]), lambda i: F.when(i <= last, i))


def finding(csses: list[str], dom, use, nodes: Column | None = None) -> Column:
    """`use(find)` where `find(node, css)` is the first match of one of `csses` inside an element, NULL if there is none;
    the element itself is a candidate and the top of what the selector sees.

    The matches are found once for the page, so that `find` costs a bisection however often it is called. Only a
    `:not()` with combinators depends on the scope as a whole: such a selector passes over the scope. Of a page whose elements
    in question are `nodes`, only the stretch that holds them is looked at.
    """
    d = _c(dom)
    csses = list(dict.fromkeys(csses))
    ready = [css for css in csses if not _linked_nots(css)]

    def find(held: dict, node: Column, css: str) -> Column:
        return let(F.struct(node["idx"].alias("first"), node["sub_end"].alias("last")), lambda scope: below(held, scope, css))

    def below(held: dict, scope: Column, css: str) -> Column:
        if css in held:
            return F.get(d, _first_in(held[css], scope["first"], scope["last"]))

        def within(part):
            page = _Page(d, part, scope["first"])
            return F.get(page.knowing(css, lambda known: _matching(css, known)), F.lit(0))

        return let(F.slice(d, scope["first"] + 1, scope["last"] - scope["first"] + 1), within)

    def bind(page: _Page, rest: list[str], held: dict) -> Column:
        if not rest:
            return use(lambda node, css: find(held, node, css))
        return let(_found(rest[0], page), lambda value: bind(page, rest[1:], {**held, rest[0]: value}))

    if nodes is None or not ready:
        return bind(_Page(d), ready, {})
    first = F.coalesce(F.array_min(F.transform(nodes, lambda n: n["idx"])), F.lit(0))
    last = F.coalesce(F.array_max(F.transform(nodes, lambda n: n["sub_end"])), F.lit(-1))

    def within_stretch(stretch):
        part = F.slice(d, stretch["first"] + 1, F.greatest(stretch["last"] - stretch["first"] + 1, F.lit(0)))
        return let(part, lambda elements: bind(_Page(d, elements, stretch["first"]), ready, {}))

    return let(F.struct(first.alias("first"), last.alias("last")), within_stretch)


def find_first(node: Column, css: str, dom="dom") -> Column:
    """First match inside an element, NULL if there is none. For many elements of a page use `finding`."""
    return finding([css], dom, lambda find: find(node, css))


def containing(outer: str, inner: str, dom="dom") -> Column:
    """First `outer` element that has an `inner` element below it, NULL if none."""
    d = _c(dom)

    def first(places):
        bound = F.struct(places.alias("at"), places.alias("top"))
        return F.try_element_at(F.filter(select(outer, d), lambda o: _first_in(bound, o["idx"] + 1, o["sub_end"]).isNotNull()), F.lit(1))

    return let(F.transform(select(inner, d), lambda n: n["idx"]), first)


def matches_frame(parsed, css: str):
    """One row per match: every page column but the DOM, `pos`, `tag`, `text` and `attrs`."""
    keep = [c for c in parsed.columns if c not in ("dom", "chunks")]
    found = F.transform(
        select(css),
        lambda n: F.struct(n["tag"].alias("tag"), text_of(n).alias("text"), n["attrs"].alias("attrs")),
    )
    rows = parsed.select(*keep, F.posexplode_outer(found).alias("pos", "_m")).where("pos is not null")
    return rows.select(*keep, "pos", "_m.tag", "_m.text", "_m.attrs")


def nodes_frame(parsed):
    """One row per element: page columns, then the element's fields.

    `d` lies inside `a` when a.idx < d.idx and d.idx <= a.sub_end on the same page; see `inside_join`.
    """
    keep = [c for c in parsed.columns if c not in ("dom", "chunks")]
    return parsed.select(*keep, F.inline_outer("dom")).where("idx is not null")


_SPAN = 64


def inside_join(outer, inner, page: str = "page_id"):
    """(page, outer_idx, inner_idx): every element of `inner` below one of `outer`; both have `page`, `idx`, `sub_end`.

    Elements meet by the stretch of 64 places that they share, so only neighbours are compared, not all pairs of a page.
    """
    stretches = F.sequence(F.floor(F.col("idx") / _SPAN), F.floor(F.col("sub_end") / _SPAN))
    o = outer.select(page, F.col("idx").alias("outer_idx"), "sub_end", F.explode(stretches).alias("_stretch"))
    i = inner.select(page, F.col("idx").alias("inner_idx"), F.floor(F.col("idx") / _SPAN).alias("_stretch"))
    met = o.join(i, [page, "_stretch"])
    return met.where("outer_idx < inner_idx and inner_idx <= sub_end").select(page, "outer_idx", "inner_idx")
