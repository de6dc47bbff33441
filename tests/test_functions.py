import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagetable.functions import http, values
from pagetable.functions.regex import group_count, java_regex


@pytest.mark.parametrize(
    "pattern, texts",
    [
        (r"^\w+$", ["été", "été\n", "a b", ""]),
        (r"axis\(.*ticks=\[([^\]]*)\]", ["axis(x ticks=[1,2])", "axis(x"]),
        (r"a{2}b{,3}c{1,}", ["aac", "aabbbbc", "aabc"]),
        (r"[[a&&b]x", ["[x", "&x", "ax", "cx"]),
        (r"[]x]+", ["]", "x", "a"]),
        (r"[^]]y", ["ay", "]y"]),
        (r"garden\.example/(?!shelf/)\w+", ["garden.example/thistle", "garden.example/shelf/thistle"]),
        (r"(?i)STRASSE|É", ["strasse", "é"]),
        (r"(?P<q>['\"]).*(?P=q)", ["'a'", "'a\""]),
        (r"a.b", ["a\rb", "a\nb", "a\u0085b"]),
        (r"x$", ["x\n", "x\r", "x\n\n"]),
        (r"\d+", ["٣", "x"]),
        (r"x\Z", ["x\n", "x"]),
        (r"{", ["{", "x"]),
        (r"}x", ["}x", "x"]),
    ],
)
def test_patterns_mean_the_same(spark, pattern, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(F.col("t").rlike(java_regex(pattern))).collect()]
    assert got == [re.search(pattern, t) is not None for t in texts]


def test_group_count():
    assert group_count("a(b)(c)") == 2 and group_count("a") == 0


def one(spark, column, **cells):
    df = spark.range(1)
    return df.select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(column).first()[0] if cells else df.select(column).first()[0]


def test_hash_and_sizes(spark):
    text = "é" * 5000
    assert one(spark, values.content_hash(F.lit(text))) == hashlib.sha256(text.encode()).hexdigest()
    assert one(spark, values.content_hash(F.lit(b"\x00\xff"))) == hashlib.sha256(b"\x00\xff").hexdigest()
    assert [one(spark, values.parse_size(F.lit(t))) for t in ("8M", "2k", "1G", "-3", "77")] == [8 << 20, 2048, 1 << 30, -1, 77]
    assert [values.size_to_bytes(t) for t in ("8M", "2k", "1G", "-3", "77")] == [8 << 20, 2048, 1 << 30, -1, 77]


def test_round_two_digits(spark):
    ratios = [(n, d) for d in range(1, 25) for n in range(d + 1)]
    df = spark.createDataFrame([(n / d,) for n, d in ratios], "r double").coalesce(1)
    got = [r[0] for r in df.select(values.round_2sig("r")).collect()]
    assert got == [float("{:.2}".format(n / d)) for n, d in ratios]


def test_elapsed(spark):
    import datetime

    seconds = [0, 59, 3600, 86399, 86400, 200000]
    df = spark.createDataFrame([(float(s),) for s in seconds], "s double").coalesce(1)
    assert [r[0] for r in df.select(values.elapsed_hms("s")).collect()] == [str(datetime.timedelta(seconds=s)) for s in seconds]


def test_strip_and_remove(spark):
    text = "  a \n"
    assert one(spark, values.py_strip(F.lit(text))) == text.strip()
    assert one(spark, values.remove_chars(F.lit("$1,000 abc"), ["$", ",", "abc"])) == "1000 "
    assert one(spark, values.remove_chars(F.lit("a-b]c^d"), ["]^", "-"], per_character=True)) == "abcd"


def test_headers(spark):
    df = spark.createDataFrame([({"Content-Type": "text/html", "X": "1", "x": "2"},)], "h map<string,string>")
    row = df.select(
        http.header_get("h", "CONTENT-type"), http.header_get("h", "none", "d"), http.lower_headers("h")
    ).first()
    assert row[0] == "text/html" and row[1] == "d" and set(row[2]) == {"content-type", "x"}


def test_cookies(spark):
    raw = 'sid="a b"; Path=/; Expires=Wed, 01 Jan 2025 00:00:00 GMT,lang=en; Secure; HttpOnly,sid=2'
    jar = http.cookies_to_map(http.split_set_cookie(F.lit(raw)))
    assert one(spark, jar) == {"lang": "en", "sid": "2"}
    old = F.create_map(F.lit("lang"), F.lit("de"))
    assert one(spark, http.merge_cookies(old, jar)) == {"lang": "de", "sid": "2"}
    assert one(spark, http.merge_cookies(old, jar, ["SID "])) == {"lang": "de"}
    assert one(spark, http.map_to_cookie(old)) == "lang=de"
    assert one(spark, http.cookies_with_url(old, F.lit(""))) == []
    assert one(spark, http.cookies_with_url(old, F.lit("http://x")))[0].asDict() == {"name": "lang", "value": "de", "url": "http://x"}


def test_content_classes(spark):
    kinds = ["text/html; charset=x", "TEXT/CSS", "text/plain", "application/rss+xml", "image/png", "application/pdf"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string").coalesce(1)
    rows = df.select(http.is_text("k"), http.ct_is_text("k"), http.is_html("k"), http.allowed_content_type("k")).collect()
    assert [tuple(r) for r in rows] == [
        (True, True, True, True),
        (True, True, False, False),
        (False, True, False, False),
        (True, True, False, True),
        (False, False, False, False),
        (False, False, False, True),
    ]
