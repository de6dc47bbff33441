"""URL expressions against the standard library's parser."""

import os.path
from urllib.parse import unquote, urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetable.functions import urls

SAMPLES = [
    "http://a.example/b/c?d=1#e",
    "HTTPS://User:pw@Host.example:8080/x;p=1/y;q?r=%20s+t",
    "http://a.example",
    "http://a.example/",
    "http://a.example/?",
    "http://a.example/a%2Fb%3Fc%23d",
    "http://a.example/%zz%",
    "http://a.example/caf%C3%A9",
    "//h.example/x",
    "/only/path.html",
    "mailto:me@example.org",
    "  http://a.example/lead\ting",
    "http://a.example/a;b/c;d;e?f;g",
    "",
    "javascript:void(0)",
    "a/b.c?x#y",
]
HREFS = [
    "", "#f", "?q=1", "?", "x", "x/y", "./x", "../x", "../../../x", "/x", "/x/../y", "/./x", "/x/.", "/x/..", "//o.example/z",
    "http://o.example/z/../w", "https://o.example", "mailto:a@b", ".", "..", "x?y#z", "/x?a=../b", "x/./y", "x//y", "HTTP://o.example/q",
]
BASES = ["http://a.example/b/c/d?q#f", "http://a.example", "http://a.example/", "https://a.example/b/", "http://a.example/b;p"]


def canonical(u):
    p = urlparse(unquote(u))
    return f"{p.scheme}://{p.netloc}{p.path}" + (f"?{p.query}" if p.query else "")


def run(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*cols).collect()]


def test_canonical_and_parts(spark):
    got = run(spark, [(u,) for u in SAMPLES], "u string", urls.canonical_url("u"), urls.url_unquote("u"), urls.url_parts("u"))
    for u, (canon, plain, parts) in zip(SAMPLES, got):
        assert canon == canonical(u), u
        assert plain == unquote(u)
        p = urlparse(u)
        assert tuple(parts) == (p.scheme, p.netloc, p.path, p.query), u


def test_join(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = run(spark, pairs, "b string, h string", urls.canonical_url(urls.url_join("b", "h")))
    wrong = [(b, h, g, canonical(urljoin(b, h))) for (b, h), (g,) in zip(pairs, got) if g != canonical(urljoin(b, h))]
    assert wrong == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/.?#;:%2f+&=é ", max_size=12), min_size=40, max_size=60))
def test_canonical_random_tails(spark, tails):
    samples = [f"http://h.example/{t}" for t in tails]
    got = run(spark, [(u,) for u in samples], "u string", urls.canonical_url("u"))
    assert [g for (g,) in got] == [canonical(u) for u in samples]


def mirror(root, u):
    p = urlparse(unquote(u))
    lead = (root if root.endswith("/") else root + "/") + p.netloc
    if os.path.splitext(os.path.basename(p.path))[1]:
        return lead + p.path
    q = p.query
    for c in "&!@":
        q = q.replace(c, "X")
    q = q.replace("/", "oXo")
    slash = p.path.endswith("/")
    if not q:
        return lead + p.path + ("index.html" if slash else "/index.html")
    return f"{lead}{p.path}X{q}-index.html"


def test_paths(spark):
    samples = [
        "http://h.example/a/b.html?x=1", "http://h.example/a/", "http://h.example/a", "http://h.example/a?x=1&y=/z!@",
        "http://h.example/a/?x=1", "http://h.example", "http://h.example/.hidden", "http://h.example/..a.b", "http://h.example/a.",
    ]
    got = run(spark, [(u,) for u in samples], "u string", urls.url_to_path("r", "u"), urls.mirror_path("r/", "u"), urls.url_to_plain_name("r", "p", "u"))
    for u, (path, safe, flat) in zip(samples, got):
        assert path == mirror("r", u), u
        assert safe == "".join(c for c in mirror("r/", u) if c not in ":*?<>|\"'"), u
        assert flat == "r/p" + "".join("-" if c in "/&|@\\*<>:?=" else c for c in u)


def test_registered_domain(spark):
    pages = spark.createDataFrame(
        [("http://a.b.co.example/x",), ("http://b.co.example:80/",), ("http://u@x.y.org",), ("http://co.example/",), ("http://none.zz/",)], "url string"
    )
    suffixes = spark.createDataFrame([("example",), ("co.example",), ("org",)], "suffix string")
    got = {r.url: r.domain for r in urls.registered_domain(pages, suffixes).collect()}
    assert got == {
        "http://a.b.co.example/x": "b.co.example",
        "http://b.co.example:80/": "b.co.example",
        "http://u@x.y.org": "y.org",
        "http://co.example/": "co.example",
        "http://none.zz/": None,
    }
