"""Header, content-type and cookie expressions over MAP and STRING columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetable.functions.regex import java_regex
from pagetable.functions.urls import url_netloc, url_path, url_scheme, url_unquote
from pagetable.functions.values import TEXT_TYPES

# Patterns of content types (accepted unless told otherwise, text, HTML), accepted schemes,
# and the commas that end a cookie rather than stand in its date.
ALLOWED_CONTENT = "(?i)(text/html?|application/.*)"
TEXT_CONTENT = r"(?i)(text/?|rss\+xml)"
HTML_CONTENT = "(?i)text/html?"
ALLOWED_SCHEMES = ("http", "https")
COOKIE_COMMA = "(?<!Mon|Tue|Wed|Thu|Fri|Sat|Sun),"
# Cookie attributes, which are not cookies of their own.
COOKIE_ATTRIBUTES = [
    "expires", "path", "comment", "domain", "max-age", "secure", "httponly", "version", "samesite", "partitioned",
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower_headers(headers) -> Column:
    """Header map with lower-case names; of names equal but for case the last wins."""
    entries = F.map_entries(_c(headers))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(
        named,
        lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def header_get(headers, key: str, default: str = "") -> Column:
    """Case-insensitive header read."""
    hits = F.filter(F.map_entries(_c(headers)), lambda e: F.lower(e["key"]) == key.lower())
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(default))


def allowed_scheme(url, schemes=ALLOWED_SCHEMES) -> Column:
    return url_scheme(url_unquote(url)).isin([s.strip().lower() for s in schemes])


def allowed_content_type(content_type, pattern: str = ALLOWED_CONTENT) -> Column:
    return F.coalesce(_c(content_type), F.lit("")).rlike(java_regex(pattern))


def is_text(content_type) -> Column:
    ct = F.lower(_c(content_type))
    return F.exists(F.array(*[F.lit(t) for t in TEXT_TYPES]), lambda t: F.contains(ct, t))


def ct_is_text(content_type) -> Column:
    return _c(content_type).rlike(java_regex(TEXT_CONTENT))


def is_html(content_type) -> Column:
    return _c(content_type).rlike(java_regex(HTML_CONTENT))


def split_set_cookie(text) -> Column:
    """Commas between cookies become line breaks; commas inside dates stay."""
    return F.regexp_replace(_c(text), COOKIE_COMMA, "\n")


def _cookie_pairs(text: Column) -> Column:
    pieces = F.split(text, r"[;\n]")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(p, r"=([\s\S]*)$", 1)), r'^"([\s\S]*)"$', "$1").alias("value"),
            p.contains("=").alias("assigned"),
        ),
    )
    return F.filter(
        pairs, lambda p: p["assigned"] & (p["key"] != "") & ~F.lower(p["key"]).isin(COOKIE_ATTRIBUTES)
    )


def cookies_to_map(text) -> Column:
    """Cookie text (one cookie per line or `;`) as name -> value; attributes are dropped, last name wins."""
    pairs = _cookie_pairs(F.coalesce(_c(text), F.lit("")))
    last = F.filter(
        pairs,
        lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def map_to_cookie(cookies) -> Column:
    entries = F.map_entries(_c(cookies))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def cookies_with_url(cookies, url) -> Column:
    """One (name, value, url) per cookie; none when the url is missing."""
    u = _c(url)
    rows = F.transform(
        F.map_entries(_c(cookies)),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), u.alias("url")),
    )
    return F.when(F.coalesce(u, F.lit("")) != "", rows).otherwise(F.filter(rows, lambda _: F.lit(False)))


def ignore_cookies(cookies, names) -> Column:
    banned = [n.strip().lower() for n in names]
    return F.map_filter(_c(cookies), lambda k, v: ~F.lower(k).isin(banned))


def merge_cookies(old, new, ignored=()) -> Column:
    """Known cookies win; unknown ones are added unless ignored."""
    known = _c(old)
    fresh = F.map_filter(ignore_cookies(new, ignored), lambda k, v: ~F.map_contains_key(known, k))
    return F.map_concat(known, fresh)


def cookies_for(cookies, url) -> Column:
    """Cookies (ARRAY<STRUCT<name,value,path,domain,url>>) that a request to `url` carries."""
    u = _c(url)
    path, host = url_path(u), url_netloc(u)
    return F.filter(
        _c(cookies),
        lambda c: ((F.coalesce(c["path"], F.lit("")) == "") | F.startswith(path, c["path"]))
        & F.contains(
            host,
            F.when(F.coalesce(c["domain"], F.lit("")) != "", c["domain"]).otherwise(url_netloc(c["url"])),
        ),
    )
