"""Selection below an element, against a plain matcher, and its time on large pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagetable import find_first, parse_dom, select
from pagetable.operators.selectors import containing, finding

# selector -> per alternative the tests from left to right with the combinator before each; a test is a tag, or (tag, excluded chain)
CHAINS = {
    "b": [[("", "b")]],
    "*": [[("", "*")]],
    "a b": [[("", "a"), (" ", "b")]],
    "b ~ i": [[("", "b"), ("~", "i")]],
    "b + i": [[("", "b"), ("+", "i")]],
    "a > b": [[("", "a"), (">", "b")]],
    "a b ~ i": [[("", "a"), (" ", "b"), ("~", "i")]],
    "a ~ b i": [[("", "a"), ("~", "b"), (" ", "i")]],
    "a b i, i ~ b": [[("", "a"), (" ", "b"), (" ", "i")], [("", "i"), ("~", "b")]],
    "i:not(b ~ i)": [[("", ("i", [("", "b"), ("~", "i")]))]],
    "a i:not(b i)": [[("", "a"), (" ", ("i", [("", "b"), (" ", "i")]))]],
    "b ~ *:not(a b ~ *)": [[("", "b"), ("~", ("*", [("", "a"), (" ", "b"), ("~", "*")]))]],
}


def holds(dom, n, chain, top):
    """Whether element n ends the chain with every element of it at `top` or later."""
    comb, test = chain[-1]
    tag, excluded = test if isinstance(test, tuple) else (test, None)
    if n < top or (tag != "*" and dom[n]["tag"] != tag) or (excluded and holds(dom, n, excluded, top)):
        return False
    if len(chain) == 1:
        return True
    link, many = {">": ("parent", False), "+": ("prev", False), " ": ("parent", True), "~": ("prev", True)}[comb]
    m = dom[n][link]
    while m >= top:
        if holds(dom, m, chain[:-1], top):
            return True
        m = dom[m][link] if many else -1
    return False


def first(dom, scope, css):
    return next((i for i in range(scope, dom[scope]["sub_end"] + 1) if any(holds(dom, i, c, scope) for c in CHAINS[css])), None)


def tree(draw, depth=0):
    inner = "".join(tree(draw, depth + 1) for _ in range(draw.randint(0, 4))) if depth < 5 else ""
    tag = draw.choice("abi")
    return f"<x{tag}>{inner}</x{tag}>"


@pytest.mark.parametrize("css", CHAINS)
def test_first_match_of_every_scope(one_page, css):
    draw = random.Random(css)
    pages = [(f"u{k}", "<body>" + "".join(tree(draw) for _ in range(3)) + "</body>") for k in range(6)]
    written = "".join("x" + c if c in "abi" and (i == 0 or css[i - 1] in " (") else c for i, c in enumerate(css))
    parsed = parse_dom(one_page(*pages))
    every = finding([written], "dom", lambda find: F.transform("dom", lambda n: find(n, written)["idx"]))
    one = find_first(F.get("dom", F.lit(1)), written)["idx"]
    some = finding([written], "dom", lambda find: F.transform(select("xa"), lambda n: find(n, written)["idx"]), select("xa")).alias("some")
    for r in parsed.select("dom", some, every.alias("got"), one.alias("one"), select(written)["idx"].alias("all")).collect():
        dom = [{**n.asDict(), "tag": n["tag"].removeprefix("x") if n["tag"].startswith("x") else "-"} for n in r.dom]
        assert r.got == [first(dom, i, css) for i in range(len(dom))]
        assert r.one == r.got[1]
        assert r.some == [first(dom, i, css) for i in range(len(dom)) if dom[i]["tag"] == "a"]
        assert r["all"] == [i for i in range(len(dom)) if any(holds(dom, i, c, 0) for c in CHAINS[css])]


def test_containing_looks_below_only(one_page):
    parsed = parse_dom(one_page(("u", "<body><xa id=1></xa><xa id=2><p><xa id=3><i></i></xa></p></xa></body>")))
    got = parsed.select(containing("xa", "i")["id"], containing("xa", "xa")["id"], containing("i", "i").isNull()).first()
    assert tuple(got) == ("2", "2", True)




def pages_of(shape, n):
    if shape == "wide":
        return "<body><a><b>0</b>" + "<li>x</li>" * n + "</a></body>"
    return "<body><a>" + "<b><div>" * (n // 2) + "</div></b>" * (n // 2) + "</a></body>"


@pytest.mark.parametrize(("shape", "css"), [("wide", "b ~ li"), ("wide", "li:not(b ~ li)"), ("wide", "b ~ i"), ("nested", "b div"), ("nested", "div i"), ("nested", "div:not(b div)")])
def test_time_grows_with_the_page(one_page, shape, css):
    """8,000 elements take at most about four times as long as 2,000, also where every element is a scope."""
    spent = {}
    for n in (500, 2_000, 8_000):
        parsed = parse_dom(one_page(("u", pages_of(shape, n)))).select(F.col("dom")).persist()
        parsed.count()
        top = F.get(select("a"), F.lit(0))
        if ":not" in css:
            asked = find_first(top, css)["idx"]
        else:
            asked = finding([css], "dom", lambda find: F.size(F.filter("dom", lambda n: find(n, css).isNotNull())))
        best = []
        for _ in range(2):
            start = time.perf_counter()
            parsed.select(asked, F.size(select(css))).collect()
            best.append(time.perf_counter() - start)
        spent[n] = min(best)
        parsed.unpersist()
    assert spent[8_000] <= 4 * spent[2_000] + 0.5, spent
