import pytest
from pyspark.sql import functions as F

from pagetable import find_first, match_count, parse_dom, select, text_of
from pagetable.operators.dom import attr_of, script_capture, visible_text
from pagetable.operators.selectors import SelectorError, containing, matches_frame

MESSY = """<!DOCTYPE html><!-- <p>not me</p> --><div id=a class="x  y" data-n='1 &amp; 2'>Hello <b>World</b>
<p>One<p>Two <i>it</i><ul><li>a<li>b<ul><li>c</ul><li>d</ul>
<table><tr><td>1<td>2<tr><td>3<td>4</table><script>var x="</p>";</script>tail<br/>line &lt;x&gt;</div>
<select><option>o1<option selected>o2</select></b></nothing>"""


def tree(one_page, html):
    rows = one_page(("u", html)).transform(parse_dom).select(
        F.explode(F.transform("dom", lambda n: F.struct(n["idx"], n["parent"], n["tag"], n["nth"], n["sub_end"], text_of(n).alias("t"))))
    )
    return [tuple(r[0]) for r in rows.collect()]


def test_recovery(one_page):
    nodes = tree(one_page, MESSY)
    assert nodes[0][2] == "div" and nodes[0][5] == "Hello World\nOne\nTwo it\na\nb\nc\nd\n1\n2\n3\n4\ntail\nline <x>"
    by_tag = {}
    for n in nodes:
        by_tag.setdefault(n[2], []).append(n)
    assert [n[5] for n in by_tag["p"]] == ["One", "Two it"]
    assert [n[5] for n in by_tag["td"]] == ["1", "2", "3", "4"]
    assert [n[3] for n in by_tag["td"]] == [1, 2, 1, 2]
    assert [n[5] for n in by_tag["li"]] == ["a", "b\nc", "c", "d"]
    assert [n[5] for n in by_tag["option"]] == ["o1", "o2"]
    assert by_tag["script"][0][5] == 'var x="</p>";'
    for idx, parent, *_ , sub_end, _t in nodes:
        assert parent < idx <= sub_end


@pytest.mark.parametrize("html", ["", "text only", "<", "<p", "<p class='", "a < b > c", "<!-- open", "<script>never closed", "</p></div>", "<a href=x/>y"])
def test_broken_sources_do_not_fail(one_page, html):
    tree(one_page, html)


def test_null_source(spark):
    df = spark.createDataFrame([("u", None)], "url string, html string")
    assert parse_dom(df).select(F.size("dom")).first()[0] == 0


@pytest.mark.parametrize(
    "css, texts",
    [
        ("li", ["a", "b\nc", "c", "d"]),
        ("#a > ul > li", ["a", "b\nc", "d"]),
        ("ul ul li", ["c"]),
        ("div.x.y b", ["World"]),
        (".x #a, b, i", ["World", "it"]),
        ("p + p", ["Two it"]),
        ("b ~ p", ["One", "Two it"]),
        ("td:nth-child(2)", ["2", "4"]),
        ("tr:last-child td:first-child", ["3"]),
        ("li:not(li li)", ["a", "b\nc", "d"]),
        ("td:nth-child(odd), td:nth-child(even)", ["1", "2", "3", "4"]),
        ("#a > li", []),
        ('[data-n="1 & 2"] > p', ["One", "Two it"]),
        ("option[selected]", ["o2"]),
        ("div *:not(:nth-child(n+2)) i", []),
        ("table tr td:nth-child(-n+1)", ["1", "3"]),
    ],
)
def test_selectors(one_page, css, texts):
    rows = matches_frame(parse_dom(one_page(("u", MESSY))), css).orderBy("pos").collect()
    assert [r["text"] for r in rows] == texts


@pytest.mark.parametrize("css", ["", "a >", "p::before", "a:hover", "[x", "li:nth-child(x)", "a $ b"])
def test_unreadable_selectors(spark, css):
    with pytest.raises(SelectorError):
        match_count(css)


def test_scope_of_sub_selectors(one_page):
    html = "<table><tr><td>1</td><td><a href='/x'>2</a></td></tr></table>"
    d = parse_dom(one_page(("u", html)))
    row = F.get(select("tr"), F.lit(0))
    got = d.select(
        text_of(find_first(row, "tr td:nth-child(2)")),
        find_first(row, "table td").isNull(),
        find_first(row, "tr").isNotNull(),
        attr_of(find_first(row, "tr td:nth-child(2) a[href]"), "href"),
        find_first(row, "th").isNull(),
    ).first()
    assert tuple(got) == ("2", True, True, "/x", True)


def test_scripts_and_visible_text(one_page):
    html = (
        "<head><title>T</title><style>s{}</style></head><body>a <b> b </b><!-- c -->"
        "<script>chart({ticks: 'x', rows: [1,2], end: 1})</script><script>chart({rows: [3]})</script></body>"
    )
    d = parse_dom(one_page(("u", html)))
    got = d.select(script_capture(r"chart\(.*rows: \[([^\]]*)\], end"), script_capture(r"^nope(x)"), visible_text()).first()
    assert tuple(got) == ("1,2", None, "a b")


def test_containing(one_page):
    html = "<form id=f1><p>x</p></form><form id=f2><button id=go>g</button></form>"
    d = parse_dom(one_page(("u", html)))
    assert d.select(containing("form", "#go")["id"], containing("form", "a").isNull()).first()[:] == ("f2", True)


def test_long_batches_are_cut(spark, monkeypatch):
    import pagetable.operators.markup as markup

    batches = spark.createDataFrame([(i, "<p>x</p>" * 50) for i in range(200)], "id int, html string").toArrow().to_batches()
    monkeypatch.setattr(markup, "_SLICE_CHARS", 1000)
    out = list(markup.parse_batches(batches, "html", ["id"]))
    assert len(out) > 50 and [i for b in out for i in b.column("id").to_pylist()] == list(range(200))


def test_hostile_sources_stay_linear(one_page):
    import time

    start = time.time()
    pages = [
        "<a" * 400_000, "<b>" * 20_000 + "x", "<p '" * 100_000 + ">", "<div>" * 20_000 + "<p>" * 20_000 + "</i>" * 20_000,
        '<a ">"' * 50_001 + "<b>y</b>", "<div><td>" + "<b>" * 20_000 + "</div>" * 20_000, "<script>a</script" * 20_000,
    ]
    parsed = one_page(*[(str(i), h) for i, h in enumerate(pages)]).transform(parse_dom)
    got = parsed.select("url", F.coalesce(F.array_max(F.transform("dom", lambda n: n["depth"])), F.lit(-1))).collect()
    depths = {r[0]: r[1] for r in got}
    assert depths["1"] == 19_999 and depths["3"] == 20_000 and depths["5"] == 20_001
    assert time.time() - start < 60


@pytest.mark.parametrize("n", [1, 100, 255, 256, 300, 1000])
def test_deep_nesting_keeps_its_place(one_page, n):
    html = "<body><div id=outer>" + "<div>" * n + "in" + "</div>" * n + "<p>y</p></div><p>z</p></body>"
    d = parse_dom(one_page(("u", html)))
    parent = lambda m: F.get("dom", m["parent"])
    got = d.select(
        F.transform(select("#outer p"), lambda m: text_of(m)),
        F.transform(select("p"), lambda m: parent(m)["tag"]),
        match_count("#outer div"),
        text_of(find_first(F.get(select("body"), F.lit(0)), "#outer div p ~ p, #outer > p")),
    ).first()
    assert tuple(got) == (["y"], ["div", "body"], n, "y")


@pytest.mark.parametrize("n", [0, 40, 60, 5000])
def test_loose_tails_mean_the_same_at_every_length(one_page, n):
    loose = "a<b " * n
    pages = one_page(("comment", f"<p>x</p><!-- {loose}"), ("script", f"<script>if(a<b){loose}"), ("text", f"<p>x</p>{loose}"))
    d = pages.transform(parse_dom).select("url", visible_text(), script_capture("(.*)"))
    got = {r[0]: (r[1], r[2]) for r in d.collect()}
    assert got["comment"] == ("x", None)
    assert got["script"] == ("", f"if(a<b){loose}")
    assert got["text"][0].replace(" ", "") == ("x" + loose).replace(" ", "")


def test_quotes_without_a_partner(one_page):
    html = "<a title='x>one</a><b class=\"k\">two</b><i data-q=\"a>b\" id=z>three</i>"
    d = parse_dom(one_page(("u", html)))
    assert d.select(F.transform("dom", lambda n: n["tag"]), match_count("b.k"), match_count("#z")).first()[:] == (["a", "b", "i"], 1, 1)


def test_wide_pages_stay_linear(one_page):
    """Four times the siblings or scripts take about four times as long."""
    import time

    def spent(html, column):
        d = parse_dom(one_page(("u", html))).cache()
        d.count()
        best = 1e9
        for _ in range(2):
            start = time.time()
            d.select(column).collect()
            best = min(best, time.time() - start)
        return best

    for make, column in [
        (lambda n: "<p>x</p>" * n, match_count("p ~ p")),
        (lambda n: "<script>x</script>t" * n, visible_text()),
        (lambda n: "<div><p>x</p>" * n, match_count("div p")),
    ]:
        spent(make(500), column)
        assert spent(make(16_000), column) < 5 * spent(make(4_000), column) + 1
