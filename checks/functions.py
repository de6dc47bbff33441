"""Checks of the scalar functions."""

from pyspark.sql import functions as F

from checks.tables import AT, CANON_URL, ORIGIN, captures, documents, pages, run_log
from pagetable.functions import http, urls, values
from pagetable.plans.checkpoints import new_folder
from pagetable.sources.tables import mirror_pages

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


def url_canonical(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonical_url("url").alias("canonical"))


def url_unquoted(spark, sf):
    """Percent-encode some characters of the URL, then decode."""
    spaced = F.regexp_replace(F.regexp_replace("url", "/", "%2F"), "=", "+%3d%z")
    return pages(spark, sf).select("page_id", urls.url_unquote(spaced).alias("decoded"))


def url_parts(spark, sf):
    return pages(spark, sf).select("page_id", urls.url_parts("url").alias("p")).select("page_id", "p.*")


def url_joined(spark, sf):
    """Relative references of several kinds, built from each page's own URL."""
    p = pages(spark, sf).select("page_id", "url", urls.url_path("url").alias("path"))
    refs = F.array(
        F.lit("/a/../b"), F.lit("?q=1"), F.lit("//h.example/x"), F.lit("https://o.example/y#z"), F.lit("./k"), F.lit("#top")
    )
    rows = p.select("page_id", "url", F.posexplode(refs).alias("pos", "href"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), urls.url_join("url", "href").alias("absolute"))


URL_JOIN_SQL = rf"""SELECT page_id, pos, CASE pos
  WHEN 0 THEN {ORIGIN} || '/b'
  WHEN 1 THEN {ORIGIN} || {PATH} || '?q=1'
  WHEN 2 THEN regexp_extract(url, '^(https?):', 1) || '://h.example/x'
  WHEN 3 THEN CASE WHEN url LIKE 'https:%' THEN 'https://o.example/y#z' ELSE 'https://o.example/y#z' END
  WHEN 4 THEN {ORIGIN} || regexp_replace({PATH}, '[^/]*$', '') || 'k'
  ELSE regexp_replace(url, '#.*$', '') || '#top' END AS absolute
  FROM pages, (SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS pos)"""


def url_mirror_path(spark, sf):
    return pages(spark, sf).select("page_id", urls.mirror_path("root", "url").alias("path"))


MIRROR_SQL = rf"""SELECT page_id, regexp_replace('root/' || host || path ||
  CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^\.*[^.].*\.') THEN ''
    WHEN query = '' THEN CASE WHEN path LIKE '%/' THEN 'index.html' ELSE '/index.html' END
    ELSE 'X' || replace(regexp_replace(query, '[&!@]', 'X', 'g'), '/', 'oXo') || '-index.html' END,
  '[:*?<>|"'']', '', 'g') AS path
  FROM (SELECT page_id, {HOST} AS host, {PATH} AS path, {QUERY} AS query FROM pages)"""


def mirror_saved(spark, sf):
    """The pages stored by the mirror sink and read back, text or not by their content type."""
    kind = F.when(F.col("page_id") % 3 == 0, F.lit("image/png")).otherwise(F.lit("text/html; charset=utf-8"))
    root = new_folder(spark, "mirror")
    mirror_pages(pages(spark, sf).withColumn("kind", kind), root, F.col("kind"))
    saved = spark.read.parquet(root)
    return saved.select("page_id", F.concat(F.lit("root"), "mirror_path").alias("path"), "as_text", F.char_length("html").cast("long").alias("n"))


MIRROR_SAVED_SQL = f"""SELECT m.page_id, m.path, m.page_id % 3 <> 0 AS as_text, length(p.html) AS n
  FROM ({MIRROR_SQL}) m JOIN pages p USING (page_id)"""


def url_plain_name(spark, sf):
    return pages(spark, sf).select("page_id", urls.url_to_plain_name("out", "p-", "url").alias("name"))


def url_registered_domain(spark, sf):
    """Public suffixes com, net and org are taken from the hosts themselves."""
    p = pages(spark, sf).select("page_id", "url")
    suffixes = p.select(F.regexp_extract(urls.url_host("url"), r"([^.]+)$", 1).alias("suffix")).distinct()
    return urls.registered_domain(p, suffixes).select("page_id", "domain")


def text_hash(spark, sf):
    return documents(spark, sf).select("doc_id", values.content_hash("text").alias("hash"))


def binary_hash(spark, sf):
    return pages(spark, sf).select("page_id", values.content_hash(F.encode("html", "UTF-8")).alias("hash"))


def body_length(spark, sf):
    """The header wins on every third page; an unreadable header counts as missing."""
    header = F.when(F.col("page_id") % 3 == 0, F.lit("123")).when(F.col("page_id") % 3 == 1, F.lit("x"))
    return pages(spark, sf).select("page_id", values.content_length("html", header).alias("n"))


def size_texts(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("K", "m", "G", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    sign = F.when(F.col("page_id") % 10 == 7, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.col("page_id").cast("string"), unit)
    return pages(spark, sf).select("page_id", values.parse_size(text).alias("bytes"))


SIZE_SQL = """SELECT page_id, CASE WHEN page_id % 4 = 3 AND page_id % 10 = 7 THEN -1
  ELSE (CASE WHEN page_id % 10 = 7 THEN -1 ELSE 1 END) * page_id *
  CASE page_id % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END END AS bytes FROM pages"""


def truth_words(spark, sf):
    words = F.array(*[F.lit(w) for w in (" True", "no", "YES ", "0", "uh-huh", "maybe")])
    word = F.element_at(words, (F.col("doc_id") % 6 + 1).cast("int"))
    return documents(spark, sf).select("doc_id", values.str_to_bool(word).alias("flag"))


def accessed_text(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", values.format_accessed("ts").alias("accessed"))


def elapsed_text(spark, sf):
    return run_log(spark, sf).select("seq", values.elapsed_hms(F.col("handling_s") * 1000 + F.col("seq")).alias("elapsed"))


ELAPSED_SQL = """SELECT event_id AS seq, CASE WHEN s < 86400 THEN '' WHEN s < 172800 THEN '1 day, '
    ELSE (s // 86400) || ' days, ' END || printf('%d:%02d:%02d', (s % 86400) // 3600, (s % 3600) // 60, s % 60) AS elapsed
  FROM (SELECT event_id, floor(value * 1000 + event_id)::BIGINT AS s FROM events)"""


def ratio_rounded(spark, sf):
    ratio = (F.col("page_id") % 7) / (F.col("page_id") % 7 + F.col("page_id") % 4 + 1)
    return pages(spark, sf).select("page_id", values.round_2sig(ratio).alias("ratio"))


RATIO_SQL = """SELECT page_id, CASE WHEN r >= 0.1 THEN round_even(r, 2) ELSE round_even(r, 3) END AS ratio
  FROM (SELECT page_id, (page_id % 7)::DOUBLE / (page_id % 7 + page_id % 4 + 1) AS r FROM pages)"""


def removed_chars(spark, sf):
    d = documents(spark, sf)
    return d.select(
        "doc_id",
        values.remove_chars("text", ["the", ","]).alias("entries"),
        values.remove_chars("text", ["ab", "."], per_character=True).alias("letters"),
    )


def header_values(spark, sf):
    c = captures(spark, sf)
    return c.select(
        "page_id",
        http.header_get("headers", "content-TYPE").alias("kind"),
        http.header_get("headers", "missing", "none").alias("missing"),
        F.array_join(F.array_sort(F.map_keys(http.lower_headers("headers"))), ",").alias("names"),
    )


HEADER_SQL = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/plain'
    WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/png' ELSE 'TEXT/HTML' END AS kind,
  'none' AS missing, 'content-type,last-modified,set-cookie,x-page' AS names FROM pages"""


def content_classes(spark, sf):
    c = captures(spark, sf).select("page_id", http.header_get("headers", "Content-Type").alias("k"))
    return c.select(
        "page_id",
        http.allowed_content_type("k").alias("allowed"),
        http.is_text("k").alias("is_text"),
        http.ct_is_text("k").alias("looks_text"),
        http.is_html("k").alias("is_html"),
    )


CLASSES_SQL = """SELECT page_id, page_id % 5 IN (0, 2, 4) AS allowed, page_id % 5 IN (0, 4) AS is_text,
  page_id % 5 IN (0, 1, 4) AS looks_text, page_id % 5 IN (0, 4) AS is_html FROM pages"""


def scheme_allowed(spark, sf):
    return captures(spark, sf).select("page_id", http.allowed_scheme("url").alias("allowed"))


def _jar(spark, sf):
    text = http.split_set_cookie(http.header_get("headers", "Set-Cookie"))
    return captures(spark, sf).select("page_id", "url", http.cookies_to_map(text).alias("jar"))


def cookie_map(spark, sf):
    jar = _jar(spark, sf)
    return jar.select("page_id", http.map_to_cookie("jar").alias("cookies"), F.size("jar").cast("long").alias("n"))


def cookie_merge(spark, sf):
    jar = _jar(spark, sf)
    old = F.create_map(F.lit("sid"), F.lit("kept"))
    return jar.select(
        "page_id",
        http.map_to_cookie(http.merge_cookies(old, "jar")).alias("merged"),
        http.map_to_cookie(http.merge_cookies(old, "jar", [" LANG"])).alias("without_lang"),
        http.map_to_cookie(http.ignore_cookies("jar", ["SID"])).alias("no_sid"),
    )


def cookie_structs(spark, sf):
    jar = _jar(spark, sf)
    rows = jar.select("page_id", F.inline(http.cookies_with_url("jar", F.col("url"))))
    return rows.select("page_id", "name", "value", F.length("url").cast("long").alias("url_length"))


def cookies_sent(spark, sf):
    """Jar entries with paths and domains; only those that fit the URL are sent."""
    text = "string"
    jar = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit("1").alias("value"), F.lit(p).cast(text).alias("path"), F.lit(d).alias("domain"), F.lit(u).alias("url"))
            for n, p, d, u in [
                ("root", "/", "example", ""),
                ("english", "/en", "example.com", ""),
                ("any", "", "", "https://example.org/x"),
            ]
        ]
    )
    return pages(spark, sf).select(
        "page_id", F.array_join(F.transform(http.cookies_for(jar, "url"), lambda c: c["name"]), ",").alias("sent")
    )


COOKIES_SENT_SQL = f"""SELECT page_id, concat_ws(',', CASE WHEN {PATH} LIKE '/%' THEN 'root' END,
  CASE WHEN {PATH} LIKE '/en%' AND {HOST} LIKE '%example.com%' THEN 'english' END,
  CASE WHEN {HOST} LIKE '%example.org%' THEN 'any' END) AS sent FROM pages"""

QUERIES = {
    "url_canonical": (url_canonical, f"SELECT page_id, {CANON_URL} AS canonical FROM pages"),
    "url_unquoted": (url_unquoted, "SELECT page_id, replace(url, '=', '+=%z') AS decoded FROM pages"),
    "url_parts": (
        url_parts,
        f"SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, {HOST} AS netloc, {PATH} AS path, {QUERY} AS query FROM pages",
    ),
    "url_joined": (url_joined, URL_JOIN_SQL),
    "url_mirror_path": (url_mirror_path, MIRROR_SQL),
    "mirror_saved": (mirror_saved, MIRROR_SAVED_SQL),
    "url_plain_name": (
        url_plain_name,
        r"SELECT page_id, 'out/p-' || translate(url, '/&|@\*<>:?=', '-----------') AS name FROM pages",
    ),
    "url_registered_domain": (
        url_registered_domain,
        f"SELECT page_id, regexp_extract({HOST}, '([^.]+[.][^.]+)$', 1) AS domain FROM pages",
    ),
    "text_hash": (text_hash, "SELECT doc_id, sha256(text) AS hash FROM documents"),
    "binary_hash": (binary_hash, "SELECT page_id, sha256(html) AS hash FROM pages"),
    "body_length": (body_length, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 123 ELSE length(html) END AS n FROM pages"),
    "size_texts": (size_texts, SIZE_SQL),
    "truth_words": (truth_words, "SELECT doc_id, doc_id % 6 IN (0, 2, 4) AS flag FROM documents"),
    "accessed_text": (accessed_text, "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS accessed FROM events"),
    "elapsed_text": (elapsed_text, ELAPSED_SQL),
    "ratio_rounded": (ratio_rounded, RATIO_SQL),
    "removed_chars": (
        removed_chars,
        "SELECT doc_id, replace(replace(text, 'the', ''), ',', '') AS entries, translate(text, 'ab.', '') AS letters FROM documents",
    ),
    "header_values": (header_values, HEADER_SQL),
    "content_classes": (content_classes, CLASSES_SQL),
    "scheme_allowed": (scheme_allowed, "SELECT page_id, page_id % 23 <> 0 AS allowed FROM pages"),
    "cookie_map": (cookie_map, "SELECT page_id, 'sid=' || page_id || ';Lang=' || (page_id % 4) AS cookies, 2 AS n FROM pages"),
    "cookie_merge": (
        cookie_merge,
        "SELECT page_id, 'sid=kept;Lang=' || (page_id % 4) AS merged, 'sid=kept' AS without_lang, 'Lang=' || (page_id % 4) AS no_sid FROM pages",
    ),
    "cookie_structs": (
        cookie_structs,
        """SELECT page_id, name, CASE name WHEN 'sid' THEN page_id::VARCHAR ELSE (page_id % 4)::VARCHAR END AS value,
  length(CASE WHEN page_id % 23 = 0 THEN regexp_replace(url, '^https?', 'ftp') ELSE url END) AS url_length
  FROM pages, (SELECT unnest(['sid', 'Lang']) AS name)""",
    ),
    "cookies_sent": (cookies_sent, COOKIES_SENT_SQL),
}
