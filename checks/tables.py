"""Inputs of the checks: the given tables and data derived from them, in Spark and in SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetable import Library, read_pages
from pagetable.functions.urls import canonical_url, url_host
from pagetable.functions.values import content_hash
from pagetable.operators.dom import parse_dom

AT = "2024-01-01 00:00:00"


def work_folder(spark: SparkSession) -> None:
    """A folder for intermediate tables where the session names none, as in a local run."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagetable-"))


# set by the benchmark, whose table is one small row group; None leaves the table's splits as they are
PAGE_TASKS: int | None = None


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet", tasks=PAGE_TASKS)


def parsed(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    keep = keep or ("page_id",)
    return parse_dom(pages(spark, sf_dir).select(*keep, "html"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), content_hash("text").alias("hash"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, host, hit, handling_s, bytes, ts from `events`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"),
        (F.col("event_type") == "purchase").cast("int").alias("hit"),
        F.col("value").alias("handling_s"),
        F.octet_length("props").cast("long").alias("bytes"),
        (F.col("event_type") != "error").alias("reached"),
        "ts",
    )


RUN_LOG_SQL = """run_log AS (SELECT event_id AS seq, 'h' || (user_id % 3) AS host,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS hit, value AS handling_s,
  strlen(props) AS bytes, event_type <> 'error' AS reached, ts FROM events)"""


def frontier_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of an earlier run: some hashes differ, some rows are missing, some are pending or failed."""
    p = pages(spark, sf_dir)
    status = F.when(F.col("page_id") % 11 == 0, F.lit(404)).when(F.col("page_id") % 9 == 0, F.lit(-1)).when(
        F.col("page_id") % 8 == 0, F.lit(-7)
    )
    return p.where("page_id % 7 <> 0").select(
        "url",
        F.col("page_id").alias("seq"),
        F.lit("01/01/2024 00:00:00").alias("fetched"),
        status.otherwise(F.lit(200)).cast("int").alias("status"),
        F.lit("text/html").alias("contenttype"),
        F.char_length("html").cast("long").alias("contentlength"),
        F.when(F.col("page_id") % 4 == 0, F.lit("Mon, 01 Jan 2024 00:00:00 GMT")).otherwise(F.lit("")).alias("lastmodified"),
        F.when(F.col("page_id") % 5 == 0, F.lit("0")).otherwise(content_hash("html")).alias("hash"),
    )


FRONTIER_SQL = """frontier_old AS (SELECT url, page_id AS seq, '01/01/2024 00:00:00' AS fetched,
  CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 9 = 0 THEN -1 WHEN page_id % 8 = 0 THEN -7 ELSE 200 END AS status,
  'text/html' AS contenttype, length(html) AS contentlength,
  CASE WHEN page_id % 4 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' ELSE '' END AS lastmodified,
  CASE WHEN page_id % 5 = 0 THEN '0' ELSE sha256(html) END AS hash
  FROM pages WHERE page_id % 7 <> 0)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetched resources with status, headers and some empty bodies."""
    p, i = pages(spark, sf_dir), F.col("page_id")
    kind = (
        F.when(i % 5 == 0, F.lit("text/html; charset=utf-8"))
        .when(i % 5 == 1, F.lit("text/plain"))
        .when(i % 5 == 2, F.lit("application/pdf"))
        .when(i % 5 == 3, F.lit("image/png"))
        .otherwise(F.lit("TEXT/HTML"))
    )
    return p.select(
        "page_id",
        F.col("page_id").alias("seq"),
        F.when(i % 23 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url")).alias("url"),
        F.when(i % 13 == 0, F.lit(404)).when(i % 17 == 0, F.lit(-7)).otherwise(F.lit(200)).alias("status"),
        F.create_map(
            F.lit("Content-Type"), kind,
            F.lit("Last-Modified"), F.when(i % 2 == 0, F.lit("Mon, 01 Jan 2024 00:00:00 GMT")).otherwise(F.lit("")),
            F.lit("X-Page"), i.cast("string"),
            F.lit("Set-Cookie"),
            F.concat(
                F.lit("sid="), i.cast("string"),
                F.lit("; Expires=Wed, 01 Jan 2025 00:00:00 GMT; Path=/,Lang="), (i % 4).cast("string"), F.lit("; Secure"),
            ),
        ).alias("headers"),
        F.when(i % 19 == 0, F.lit("")).otherwise(F.col("html")).alias("html"),
    )


CAPTURES_SQL = """captures AS (SELECT page_id, page_id AS seq,
  CASE WHEN page_id % 23 = 0 THEN regexp_replace(url, '^https?', 'ftp') ELSE url END AS url,
  CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 17 = 0 THEN -7 ELSE 200 END AS http_status,
  CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/pdf'
    WHEN 3 THEN 'image/png' ELSE 'TEXT/HTML' END AS contenttype,
  CASE WHEN page_id % 2 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' ELSE '' END AS lastmodified,
  CASE WHEN page_id % 19 = 0 THEN '' ELSE html END AS html FROM pages),
gated AS (SELECT *, length(html) AS contentlength,
  CASE WHEN url LIKE 'ftp%' THEN -11 WHEN http_status <> 200 THEN http_status
    WHEN contenttype IN ('text/plain', 'image/png') THEN -700
    WHEN length(html) = 0 THEN -999 ELSE 200 END AS status FROM captures)"""


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with two links per page to other captured pages: 7i+1 and 3i+2 modulo the page count."""
    p = pages(spark, sf_dir)
    n = p.count()
    key = p.select("page_id", canonical_url("url").alias("u"))
    a = key.select(F.col("page_id").alias("_a"), F.col("u").alias("ua"))
    b = key.select(F.col("page_id").alias("_b"), F.col("u").alias("ub"))
    ids = p.select("page_id").distinct()
    wired = ids.withColumns({"_a": (F.col("page_id") * 7 + 1) % n, "_b": (F.col("page_id") * 3 + 2) % n})
    link = F.concat(F.lit('<div id="next"><a href="'), "ua", F.lit('">x</a><a href="'), "ub", F.lit('">y</a></div>'))
    links = wired.join(a, "_a").join(b, "_b").select("page_id", link.alias("_link"))
    # only narrow rows meet twice; sources are moved once
    return p.join(links, "page_id").select(
        "page_id", canonical_url("url").alias("url"), F.concat("html", "_link").alias("html")
    )


def seed(spark: SparkSession, sf_dir: str, page_id: int = 0) -> DataFrame:
    p = pages(spark, sf_dir).where(F.col("page_id") == page_id)
    return p.select(F.lit(0).cast("long").alias("seq"), canonical_url("url").alias("url"))


def host_of(url: str = "url"):
    return url_host(url)


def library(rules: list[dict], cols=(), required=(), minimum: float = -1.0) -> Library:
    return Library.from_dict(
        {
            "csvLineFormat": list(cols),
            "requiredFilledFields": list(required),
            "allowedMinimumFilled": minimum,
            "library": rules,
        }
    )


FLAGSHIP = library(
    [
        {"ruleName": "title", "ruleURLActivationCondition": ["/en/"], "ruleCSSSelector": "article h1",
         "ruleTargetAttribute": "text", "ruleReturnedMatchPos": 0},
        {"ruleName": "firstLink", "ruleCSSSelector": "nav > ul > li > a[href]", "ruleTargetAttribute": "href",
         "ruleReturnedMatchPos": 0},
        {"ruleName": "trackId", "ruleTarget": "js", "ruleContentCondition": r"track\((\d+)\)"},
        {"ruleName": "getLinks", "ruleCSSSelector": "a[href]", "ruleTargetAttribute": "href", "ruleReturnsMore": True},
    ],
    cols=["title", "firstLink", "trackId"],
    required=["title"],
    minimum=0.6,
)


# --- SQL fragments -------------------------------------------------------------------------------


def unescaped(x: str) -> str:
    """The character references that occur in the pages."""
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


def flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\r\n\f]+', ' ', 'g'))"


def inner(tag_open: str, tag_close: str, source: str = "html") -> str:
    """Text between two tags, first occurrence."""
    return flat(unescaped(f"regexp_extract({source}, '(?s){tag_open}(.*?){tag_close}', 1)"))


H1 = inner("<h1>", "</h1>")
AD = inner('<div class="ad">', "</div>")
FOOTER = inner("<footer>", "</footer>")
ARTICLE_B = inner("<p><b>", "<br>")
TRACK = r"regexp_extract(html, 'track\((\d+)\)', 1)"
HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
N_LINKS = f"len({HREFS})"
N_P = "len(regexp_extract_all(html, '<p>'))"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
CANON_URL = "regexp_replace(url, '#.*$', '')"
LINKS_SQL = f"""links AS (SELECT page_id, url, pos, {unescaped('href')} AS href FROM (
  SELECT page_id, url, unnest({HREFS}) AS href, generate_subscripts({HREFS}, 1) - 1 AS pos FROM pages))"""
EDGES_SQL = rf"""{LINKS_SQL}, edges AS (SELECT url AS src_url,
  {ORIGIN} || regexp_replace(regexp_replace(href, '#.*$', ''), ';[^/?]*$', '') AS dst_url, pos FROM links)"""
# of pages with one canonical URL the first counts
WALK_SQL = f"""keyed AS (SELECT page_id, {CANON_URL} AS url, html, count(*) OVER () AS n,
  min(page_id) OVER (PARTITION BY {CANON_URL}) AS first FROM pages),
walk(id, depth) AS (SELECT 0::BIGINT, 0
  UNION SELECT k.first, w.depth + 1 FROM walk w
    JOIN keyed k ON k.page_id IN ((7 * w.id + 1) % k.n, (3 * w.id + 2) % k.n) WHERE w.depth < 30),
reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""
# the same walk with the place of every page in the queue: level by level, by the place of its source, then of its link
PLACES_SQL = f"""keyed AS (SELECT page_id, {CANON_URL} AS url, html, count(*) OVER () AS n,
  min(page_id) OVER (PARTITION BY {CANON_URL}) AS first FROM pages),
walk(id, depth, path, source) USING KEY (id) AS (SELECT 0::BIGINT, 0, []::INTEGER[], NULL::BIGINT
  UNION SELECT id, min(depth), min(path), arg_min(source, path) FROM (
    SELECT k.first AS id, w.depth + 1 AS depth, list_append(w.path, e.pos) AS path, w.id AS source
    FROM walk w, keyed k, (VALUES (0), (1)) e(pos)
    WHERE k.page_id = CASE e.pos WHEN 0 THEN (7 * w.id + 1) % k.n ELSE (3 * w.id + 2) % k.n END) c
  WHERE id NOT IN (SELECT id FROM recurring.walk) GROUP BY id),
placed AS (SELECT w.id, w.depth, w.source, k.url, row_number() OVER (ORDER BY w.depth, w.path) - 1 AS seq
  FROM walk w JOIN keyed k ON k.page_id = w.id),
queued AS (SELECT p.*, s.url AS discovered_from, s.seq AS source_seq FROM placed p LEFT JOIN placed s ON s.id = p.source)"""
