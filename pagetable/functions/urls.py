"""URL expressions: all built-in Spark functions, safe inside any projection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# scheme, authority (with //), path, query (with ?), fragment (with #)
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
# scheme, authority without //, path, non-empty query; `;params` and fragment are left out
_CANONICAL = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*?)(?:;[^/?#]*)?(\?[^#]+)?\??(?:#[\s\S]*)?$"
)
_BLANKS = "".join(map(chr, range(33)))


# Mirror file naming and the characters that flat names and mirrored paths do without.
INDEX_NAME, QUERY_MARK, QUERY_REPLACED, QUERY_SLASH, QUERY_INDEX = "index.html", "X", "[&!@]", "oXo", "-index.html"
FLAT_REPLACED = "/&|@\\*<>:?="
PATH_REFUSED = "[:*?<>|\"']"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_unquote(url) -> Column:
    """Percent-decode; `+` stays `+` and a `%` that starts no escape stays as it is."""
    u = _c(url)
    guarded = F.regexp_replace(F.replace(u, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(u.contains("%"), F.try_url_decode(guarded)).otherwise(u)


def _clean(u: Column) -> Column:
    """Without leading blanks and control characters, tabs and line breaks."""
    return F.translate(F.ltrim(u, F.lit(_BLANKS)), "\t\r\n", "")


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_clean(_c(url)), _SPLIT, 1))


def url_netloc(url) -> Column:
    return F.substring(F.regexp_extract(_clean(_c(url)), _SPLIT, 2), 3, 2147483647)


def url_raw_path(url) -> Column:
    """Path with its `;params`."""
    return F.regexp_extract(_clean(_c(url)), _SPLIT, 3)


def url_path(url) -> Column:
    """Path without the `;params` of its last segment."""
    return F.regexp_replace(url_raw_path(url), r";[^/]*$", "")


def url_query(url) -> Column:
    return F.substring(F.regexp_extract(_clean(_c(url)), _SPLIT, 4), 2, 2147483647)


def url_parts(url) -> Column:
    u = _c(url)
    return F.struct(
        url_scheme(u).alias("scheme"),
        url_netloc(u).alias("netloc"),
        url_path(u).alias("path"),
        url_query(u).alias("query"),
    )


def _lower_scheme(u: Column) -> Column:
    scheme = F.substring_index(u, ":", 1)
    return F.concat(F.lower(scheme), F.substring(u, F.length(scheme) + 1, F.length(u)))


def canonical_url(url) -> Column:
    """Decoded URL without fragment and `;params`."""
    u = F.regexp_replace(_clean(url_unquote(url)), _CANONICAL, "$1://$2$3$4")
    return F.when(u.rlike("^[a-z0-9+.-]*[A-Z]"), _lower_scheme(u)).otherwise(u)


def url_host(url) -> Column:
    """Network location of the decoded URL (the unit of politeness and of mirroring)."""
    return url_netloc(url_unquote(url))


def _dot_segments(path: Column) -> Column:
    """Resolve `.` and `..`; a trailing one leaves a trailing slash."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    joined = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    resolved = F.when(joined == "", F.lit("/")).otherwise(joined)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), resolved).otherwise(F.when(path == "", F.lit("/")).otherwise(path))


def url_join(base, href) -> Column:
    """Absolute URL of `href` found on page `base` (RFC 3986 resolution)."""
    b, h = _clean(_c(base)), _clean(_c(href))

    def part(u, i):
        return F.regexp_extract(u, _SPLIT, i)

    scheme, h_scheme = F.lower(part(b, 1)), F.lower(part(h, 1))
    h_auth, h_path, h_query, h_frag = part(h, 2), part(h, 3), part(h, 4), part(h, 5)
    b_path = part(b, 3)
    folder = F.regexp_extract(b_path, r"^(.*/)?[^/]*$", 1)
    merged = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h_path), r"(?<=/)/+", "")
    root = F.concat(scheme, F.lit(":"), part(b, 2))
    same_scheme = (h_scheme == "") | (h_scheme == scheme)
    # most links: a path from the root without dot segments
    rooted = h.rlike(r"^/(?!/)") & ~h.contains("/.") & b.rlike(r"^[a-z][a-z0-9+.\-]*://")
    return (
        F.when(rooted, F.concat(F.regexp_extract(b, "^[^/]*//[^/?#]*", 0), h))
        .when(b == "", h)
        .when(h == "", b)
        .when(~same_scheme, h)
        .when(h_auth != "", F.concat(scheme, F.lit(":"), h_auth, h_path, h_query, h_frag))
        .when(
            h_path == "",
            F.concat(root, b_path, F.when(h_query.isin("", "?"), part(b, 4)).otherwise(h_query), h_frag),
        )
        .when(h_path.startswith("/"), F.concat(root, _dot_segments(h_path), h_query, h_frag))
        .otherwise(F.concat(root, _dot_segments(merged), h_query, h_frag))
    )


def url_to_path(root, url) -> Column:
    """File path of a page inside a mirror folder."""
    r = F.lit(root) if isinstance(root, str) else root
    u = url_unquote(url)
    path, query = url_path(u), url_query(u)
    prefix = F.concat(F.when(r.endswith("/"), r).otherwise(F.concat(r, F.lit("/"))), url_netloc(u))
    has_extension = F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"^\.*[^.].*\.")
    tail = F.replace(F.regexp_replace(query, QUERY_REPLACED, QUERY_MARK), F.lit("/"), F.lit(QUERY_SLASH))
    index = F.when(
        query == "", F.when(path.endswith("/"), F.lit(INDEX_NAME)).otherwise(F.lit("/" + INDEX_NAME))
    ).otherwise(F.concat(F.lit(QUERY_MARK), tail, F.lit(QUERY_INDEX)))
    return F.concat(prefix, path, F.when(has_extension, F.lit("")).otherwise(index))


def mirror_path(root, url) -> Column:
    """`url_to_path` without the characters that file systems refuse."""
    return F.regexp_replace(url_to_path(root, url), PATH_REFUSED, "")


def url_to_plain_name(root: str, prefix: str, url) -> Column:
    """Flat file name: separators and reserved characters become `-`."""
    lead = root if root == "" or root.endswith("/") else root + "/"
    return F.concat(F.lit(lead + prefix), F.translate(_c(url), FLAT_REPLACED, "-" * len(FLAT_REPLACED)))


def registered_domain(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Adds `domain`: the longest public suffix of the host plus one label.

    `suffixes` has one column `suffix`. Each distinct host is expanded to its tails (as many as it
    has labels), which join the suffix list by equality; URLs meet the result by host.
    """
    host = F.lower(F.regexp_replace(url_netloc(url), r"^.*@|:\d+$", ""))
    placed = urls.withColumn("_h", host)
    labels = F.split("_h", r"\.")
    tails = placed.select("_h").distinct().select("_h", F.posexplode(F.sequence(F.lit(1), F.size(labels)))).select(
        "_h",
        F.col("col").alias("_k"),
        F.array_join(F.slice(labels, F.col("col"), F.size(labels)), ".").alias("suffix"),
    )
    best = tails.join(suffixes.select("suffix").distinct(), "suffix").groupBy("_h").agg(F.min("_k").alias("_k"))
    named = best.select(
        "_h",
        F.array_join(F.slice(labels, F.greatest(F.col("_k") - 1, F.lit(1)), F.size(labels)), ".").alias("domain"),
    )
    return placed.join(named, "_h", "left").select(*urls.columns, "domain")
