"""Expanding a link frontier over a captured corpus, one level of links per iteration.

The corpus is parsed once: every page is reduced to its gate outcome, content hash, links and
gated records, written to the checkpoint folder. The loop then joins small levels with that narrow
table; page sources are not touched again. Each level is written before it is used, so no lineage
grows and a lost executor costs one task.

Breadth-first results equal a page-by-page walk: `seq` orders URLs by (source page, link position),
the first page with a content hash wins, and limits cut the level at the exact page. Depth-first
order numbers the same discovery forest in pre-order; a URL that several pages link to belongs to
the page that met it first breadth-first. A page-by-page depth-first walk may differ in order and
parents, and no parallel walk can reproduce it (each turn depends on all before), so depth-first
order takes no limit: with one, other pages would be extracted than such a walk extracts.

Queue entries are kept as given; they meet the corpus by their canonical form.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetable.functions.http import (
    ALLOWED_CONTENT,
    ALLOWED_SCHEMES,
    allowed_content_type,
    allowed_scheme,
    header_get,
    is_html,
)
from pagetable.functions.urls import canonical_url
from pagetable.functions.values import content_hash, content_length, format_accessed, size_to_bytes
from pagetable.operators.dom import parse_dom
from pagetable.operators.frontier import first_links, within_bytes
from pagetable.operators.quality import passes_gate
from pagetable.operators.records import append
from pagetable.operators.runlog import below_rate_streak, stop_seq, streak_state
from pagetable.operators.scan import first_rows, number_rows
from pagetable.plans.checkpoints import bucketed_table, run_folder, through_table
from pagetable.plans.extraction import LINKS, link_array, page_rows, stamp
from pagetable.plans.library import Library
from pagetable.schemas import BAD_CONTENT_TYPE, BAD_SCHEME, EMPTY_BODY, NOT_CAPTURED, PENDING
from pagetable.sources.tables import csv_view

FRONTIER_COLUMNS = [
    "url", "seq", "depth", "discovered_from", "fetched", "status", "contenttype", "contentlength", "lastmodified", "hash",
]


_SETTLED = (
    "url string, seq long, depth int, discovered_from string, src long, pos long, status int, contenttype string, "
    "contentlength long, lastmodified string, hash string, reached boolean"
)
_QUEUED = "url string, key string, depth int, discovered_from string, src long, pos long"
SMALL = 20_000  # rows of a level that are broadcast, and shuffled and ordered in one task
FEW = 500  # URLs that are looked up by name, so that other buckets of a corpus of MANY rows are not read
MANY = 1_000_000


@dataclass(frozen=True)
class CrawlResult:
    """`folder` holds the run's tables; `plans.checkpoints.drop_folder` removes it when the results are used."""

    frontier: DataFrame
    records: DataFrame
    levels: int
    folder: str


def gate_captures(captures: DataFrame, content_types: str = ALLOWED_CONTENT, schemes=ALLOWED_SCHEMES) -> DataFrame:
    """+ contenttype, contentlength, lastmodified, status (gate outcome), hash (accepted pages only), html_page.

    `captures` has url and html, and may have status and headers; plain pages count as 200 text/html.
    """
    columns = set(captures.columns)
    http_status = F.coalesce("status", F.lit(-999)) if "status" in columns else F.lit(200)
    if "headers" in columns:
        kind = header_get("headers", "Content-Type")
        modified, declared = header_get("headers", "Last-Modified"), header_get("headers", "Content-Length")
    else:
        kind, modified, declared = F.lit("text/html"), F.lit(""), None
    out = captures.withColumns(
        {
            "contenttype": kind,
            "lastmodified": modified,
            "contentlength": F.coalesce(content_length("html", declared), F.lit(0)),
        }
    )
    status = (
        F.when(~allowed_scheme("url", schemes), F.lit(BAD_SCHEME))
        .when(http_status != 200, http_status)
        .when(~allowed_content_type("contenttype", content_types), F.lit(BAD_CONTENT_TYPE))
        .when(F.col("contentlength") <= 0, F.lit(EMPTY_BODY))
        .otherwise(F.lit(200))
    )
    out = out.withColumn("status", status.cast("int"))
    good = F.col("status") == 200
    return out.withColumns({"hash": F.when(good, content_hash("html")), "html_page": good & is_html("contenttype")})


def corpus_facts(pages: DataFrame, lib: Library, content_types: str, schemes) -> DataFrame:
    """One narrow row per captured page: gate outcome, hash, resolved links, gated records."""
    named = pages.withColumn("url", canonical_url("url"))
    gated = gate_captures(named, content_types, schemes)
    order = next((c for c in ("seq", "page_id") if c in pages.columns), None)
    rank = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    kept = ["url", "_rank", "status", "contenttype", "contentlength", "lastmodified", "hash", "html_page"]
    source = F.when(F.col("html_page"), F.col("html")).alias("html")
    narrow = gated.withColumn("_rank", rank).select(*kept, source)
    parsed = parse_dom(narrow)
    def links(by_key):
        if LINKS not in by_key:
            return {"links": F.array().cast("array<string>")}
        return {"links": link_array(by_key[LINKS], lib.rule(LINKS).content_regex)}

    rows = page_rows(parsed, lib, extra=links)
    if lib.csv_cols:
        schema = rows.schema["_rows"].dataType.elementType
        kept_rows = F.filter(
            "_rows", lambda r: passes_gate(schema, lib.csv_cols, lib.required, lib.min_filled, cell=lambda n: r[n])
        )
    else:
        kept_rows = F.array()
    return rows.select(
        *kept, F.when(F.col("html_page"), F.col("links")).alias("links"), F.when(F.col("html_page"), kept_rows).alias("rows")
    )


def _met_in(seen: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """Keys of `some` that the growing table `seen` has; `seen` is only shuffled when `some` is large."""
    return seen.select(key).join(some.select(key), key, "left_semi")


class _Walk:
    """Three actions per level: new URLs are written, counted, and written again with their outcome.

    Queue rows have `src`, the place of the page that they were found on, and `pos`, their place on it.
    """

    def __init__(self, pages, lib, accessed_at, content_types, schemes, base):
        self.spark, self.lib, self.accessed_at = pages.sparkSession, lib, accessed_at
        self.schemes = schemes
        self.base = base
        facts = through_table(corpus_facts(pages, lib, content_types, schemes), f"{self.base}/facts")
        # of several captures of one URL the earliest counts
        first = facts.groupBy("url").agg(F.min("_rank").alias("_rank"))
        once = facts.join(first, ["url", "_rank"], "left_semi").withColumn("_n", F.size("rows"))
        # bucketed by URL: of a level that is not broadcast, only its own rows are shuffled
        self.facts = bucketed_table(once.withColumnRenamed("url", "key"), f"{self.base}/corpus", "key")
        self.corpus_rows = self.facts.count()
        self.queued: list[str] = []
        self.done: list[str] = []
        self.size, self.top, self.bytes, self.fresh = 0, -1, 0, 0
        self.rate = (0, 0, 0)
        self.session = self.spark

    @cached_property
    def quick(self) -> SparkSession:
        """A session for small levels: what they shuffle is one partition, which needs no plan at run time."""
        own = self.spark.newSession()
        for name, value in self.spark.conf.getAll.items():
            if own.conf.isModifiable(name):
                own.conf.set(name, value)
        own.conf.set("spark.sql.adaptive.enabled", "false")
        own.conf.set("spark.sql.shuffle.partitions", "1")
        return own

    def keep_earlier(self, earlier: DataFrame) -> None:
        """URLs and hashes of an earlier run count as seen."""
        queued, done = f"{self.base}/queue-earlier", f"{self.base}/done-earlier"
        rows = earlier.withColumns({"key": canonical_url("url"), "src": F.lit(None), "pos": F.lit(None)})
        self.add(rows, queued)
        self.top = max(self.top, earlier.agg(F.max("seq")).first()[0] or -1)
        through_table(earlier.select("hash"), done)
        self.done.append(done)

    def read(self, paths: list[str], columns: str) -> DataFrame:
        """Some columns of several level tables; stating them spares a look into the files."""
        return self.session.read.schema(columns).parquet(*paths)

    def add(self, rows: DataFrame, path: str) -> DataFrame:
        """Writes new URLs and counts them."""
        wanted = [c.split() for c in _QUEUED.split(", ")]
        level = through_table(rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in wanted]), path)
        self.queued.append(path)
        self.fresh, size = level.agg(F.count("*"), F.sum(F.octet_length("url"))).first()
        self.size += self.fresh
        self.bytes += size or 0
        self.session = self.quick if self.fresh <= SMALL else self.spark
        return self.read([path], _QUEUED)

    def queue(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """New URLs with `seq`, which grows in queue order from level to level but is not dense yet. Every row of `rows` has
        another (src, pos), so the numbers come out alike whenever they are computed from the written rows."""
        path = f"{self.base}/queue-{len(self.queued)}"
        level = self.add(rows, path)
        order = [*order, "url"]
        if self.fresh <= SMALL:
            ordered = level.coalesce(1).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id() + F.lit(self.top + 1))
            self.top += self.fresh
        else:
            numbered = level.orderBy(*order).withColumn("seq", F.monotonically_increasing_id() + F.lit(self.top + 1))
            ordered = through_table(numbered, f"{path}-ordered")
            self.top = ordered.agg(F.max("seq")).first()[0]
        return ordered

    def looked_up(self, level: DataFrame) -> DataFrame:
        """The level's rows with what the corpus has of them; rows that it lacks have NULLs."""
        if self.fresh > SMALL:
            facts = self.facts.drop("rows", "_rank")  # bucketed: only the level is shuffled
            return through_table(level.join(facts, "key", "left"), f"{self.base}/met-{len(self.done)}")
        if self.fresh <= FEW and self.corpus_rows >= MANY:
            facts = self.facts.where(F.col("key").isin([r[0] for r in level.select("key").distinct().collect()]))
        else:
            facts = self.session.read.schema(self.facts.schema).parquet(f"{self.base}/corpus")
        facts = facts.drop("rows", "_rank")
        # the corpus stays where it is; an outer join could not broadcast the level
        told = [c for c in facts.columns if c != "key"]
        met = facts.join(F.broadcast(level), "key").select(*level.columns, F.struct(*told).alias("told"))
        both = met.unionByName(level.withColumn("told", F.lit(None).cast(met.schema["told"].dataType)))
        kept = [F.first(c).alias(c) for c in level.columns if c != "seq"]
        found = both.groupBy("seq").agg(*kept, F.first("told", ignorenulls=True).alias("told")).select(*level.columns, "told.*")
        # what follows uses it several times, and each would read the whole corpus
        return through_table(found, f"{self.base}/met-{len(self.done)}")

    def visit(self, level: DataFrame) -> DataFrame:
        """Every row's outcome as if all of the level were fetched, written."""
        looked_up = self.looked_up(level)
        status = (
            F.when(~allowed_scheme("url", self.schemes), F.lit(BAD_SCHEME))
            .otherwise(F.coalesce("status", F.lit(NOT_CAPTURED)))
            .cast("int")
        )
        looked_up = looked_up.withColumn("status", status)
        first = looked_up.where("hash is not null").groupBy("hash").agg(F.min("seq").alias("seq"))
        if self.done:
            known = _met_in(self.read(self.done, "hash string").where("hash is not null"), self.brief(first), "hash")
            first = first.join(known, "hash", "left_anti")
        flagged = looked_up.join(self.brief(first.select("seq", F.lit(True).alias("_new"))), "seq", "left")
        new = F.coalesce("_new", F.lit(False))
        visited = flagged.select(
            *[c for c in looked_up.columns if c not in ("hash", "key")],
            F.when(new, F.col("hash")).alias("hash"),
            (new & F.coalesce("html_page", F.lit(False))).alias("reached"),
        )
        return through_table(visited, f"{self.base}/done-{len(self.done)}")

    def brief(self, rows: DataFrame) -> DataFrame:
        """Broadcast what comes from a level of a checked size."""
        return F.broadcast(rows) if self.fresh <= SMALL else rows

    def settle(self, visited: DataFrame, stop: int | None) -> DataFrame:
        """The level as it counts; pages after `stop` go back to pending."""
        path = f"{self.base}/done-{len(self.done)}"
        cells = ["status", "contenttype", "contentlength", "lastmodified", "hash"]
        if stop is not None:
            inside = F.col("seq") <= stop
            visited = visited.withColumns(
                {
                    **{c: F.when(inside, F.col(c)) for c in cells if c != "status"},
                    "status": F.when(inside, F.col("status")).otherwise(F.lit(PENDING)),
                    "reached": inside & F.col("reached"),
                }
            )
            path += "-stopped"
            visited = through_table(visited, path)
        self.done.append(path)
        return visited

    def next_level(self, done: DataFrame, max_size: int, max_bytes) -> DataFrame:
        """New URLs on the reached pages, as far as the queue limits allow."""
        links = done.where("reached").select(
            F.col("url").alias("discovered_from"),
            F.col("seq").alias("src"),
            (F.col("depth") + 1).alias("depth"),
            F.posexplode("links").alias("pos", "url"),
        )
        candidates = first_links(links, order=("src", "pos"))
        if self.fresh > SMALL:
            candidates = through_table(candidates, f"{self.base}/links-{len(self.queued)}")
        known = _met_in(self.read(self.queued, "url string"), candidates, "url")
        fresh = candidates.join(known, "url", "left_anti").withColumn("key", canonical_url("url"))
        order = ["src", "pos"]
        if max_size >= 0:
            fresh = first_rows(fresh, order, max(max_size - self.size, 0))
        if size_to_bytes(max_bytes) > 0:
            fresh = within_bytes(number_rows(fresh, order, "_n"), self.bytes, max_bytes, "_n").drop("_n")
        return self.queue(fresh, order)


def crawl(
    pages: DataFrame,
    lib: Library,
    seeds: DataFrame,
    order: str = "bfs",
    max_pages: int = -1,
    max_queue_size: int = -1,
    max_queue_bytes="-1",
    min_hit_rate: float = -1.0,
    hit_samples: int = 50,
    max_levels: int | None = None,
    accessed_at=None,
    content_types: str = ALLOWED_CONTENT,
    schemes=ALLOWED_SCHEMES,
    frontier: DataFrame | None = None,
) -> CrawlResult:
    """Walk from `seeds` (seq, url) over `pages`; see `resume` for continuing a saved frontier.

    Returns the frontier (one row per queued URL) and the records of the pages that were extracted.
    The run stops when nothing is pending, after `max_pages` processed pages, or after
    `hit_samples` consecutive pages below `min_hit_rate`.
    """
    limited = max_pages > 0 or min_hit_rate > 0 or max_queue_size >= 0 or size_to_bytes(max_queue_bytes) > 0 or max_levels
    if order.lower() == "dfs" and limited:
        raise ValueError("depth-first order takes no limit: which pages come first depends on visiting one page at a time")
    with run_folder(pages.sparkSession, "crawl") as base:
        walk = _Walk(pages, lib, accessed_at, content_types, schemes, base)
        return _crawl(walk, seeds, order.lower() == "dfs", max_pages, max_queue_size, max_queue_bytes, min_hit_rate, hit_samples, max_levels, frontier)


def _crawl(walk, seeds, dfs, max_pages, max_queue_size, max_queue_bytes, min_hit_rate, hit_samples, max_levels, frontier) -> CrawlResult:
    earlier = None
    if frontier is not None:
        old = frontier.where(F.col("status") != PENDING)
        kept = old.select(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in FRONTIER_COLUMNS])
        earlier = kept.withColumn("seq", F.col("seq").cast("long"))
        walk.keep_earlier(earlier)
    level = walk.queue(_starting_rows(seeds, frontier, max_queue_size), ["src", "pos"])
    processed, levels, stopped = 0, 0, False
    pending_level = None
    while not stopped and walk.fresh:
        visited = walk.visit(level)
        stop = None
        if max_pages > 0:
            reached = visited.where("reached").select("seq")
            n, left = reached.count(), max_pages - processed
            processed += n
            if n >= left:
                stop = first_rows(reached, ["seq"], left).agg(F.max("seq")).first()[0]
                stopped = True
        if min_hit_rate > 0:
            rate_edge = _rate_stop(walk, visited, min_hit_rate, hit_samples)
            if rate_edge is not None:
                stop, stopped = (rate_edge if stop is None else min(stop, rate_edge)), True
        done = walk.settle(visited, stop)
        levels += 1
        level = walk.next_level(done, max_queue_size, max_queue_bytes)
        if stopped or (max_levels is not None and levels >= max_levels):
            pending_level = level
            break
    return _result(walk, earlier, pending_level, levels, dfs)


def _starting_rows(seeds: DataFrame, frontier: DataFrame | None, max_size: int) -> DataFrame:
    """Pending URLs of a saved frontier, then the seeds, each with its place (_old, _at)."""
    first = seeds.groupBy("url").agg(F.min("seq").alias("_at")).withColumns({"_old": F.lit(1), "depth": F.lit(0)})
    if frontier is not None:
        first = first.join(frontier.select("url"), "url", "left_anti")
        depth = F.coalesce("depth", F.lit(0)) if "depth" in frontier.columns else F.lit(0)
        waiting = frontier.where(F.col("status") == PENDING)
        old = waiting.select("url", F.col("seq").alias("_at"), F.lit(0).alias("_old"), depth.alias("depth"))
        first = old.unionByName(first)
    elif max_size >= 0:
        first = first_rows(first, ["_at"], max_size)
    # places before all pages that will be found: pending ones first
    return first.withColumns(
        {"discovered_from": F.lit(None).cast("string"), "src": F.col("_old") - 2, "pos": F.col("_at"), "key": canonical_url("url")}
    )


def _rate_stop(walk: _Walk, visited: DataFrame, min_rate: float, samples: int) -> int | None:
    """First page of the level at which the below-minimum streak is long enough; what the next level needs is carried."""
    hit = F.when(F.col("reached"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).alias("hit")
    streaks = below_rate_streak(visited.select("seq", "reached", hit), min_rate, samples, reached="reached", start=walk.rate)
    walk.rate = streak_state(streaks, walk.rate)
    return stop_seq(streaks.where("reached"), samples).first()["stop"]


def preorder(rows: DataFrame, folder: str) -> DataFrame:
    """(seq, place): each row's place from 0 on in pre-order of the forest that `src` (a row's `seq`, negative for roots) spans,
    the last child by `pos` first.

    List ranking: every row has an arc into it and one out of it, each arc a successor (first child, next sibling or
    back to the parent). The arcs into rows that lie ahead are counted by pointer jumping, so the number of rounds is the
    logarithm of the number of rows, however deep the forest is. Roots are ordered by (src, pos) as one list.
    """
    narrow = through_table(rows.select("seq", "src", "pos"), f"{folder}/forest")
    below = narrow.where("src >= 0")
    last = below.groupBy("src").agg(F.max(F.struct("pos", "seq")).alias("_c")).select(F.col("src").alias("seq"), F.col("_c.seq").alias("child"))
    following = Window.partitionBy("src").orderBy(F.col("pos").desc(), F.col("seq").desc())
    siblings = below.select("seq", "src", F.lead("seq").over(following).alias("next"))
    roots = through_table(number_rows(narrow.where("src < 0").withColumns({"_a": -F.col("src"), "_b": -F.col("pos")}), ["_a", "_b"], "_i"), f"{folder}/roots")
    after = roots.select(F.col("seq").alias("next"), (F.col("_i") - 1).alias("_i"))
    linked = siblings.unionByName(roots.join(after, "_i", "left").select("seq", F.lit(None).cast("long").alias("src"), "next"))
    linked = linked.join(last, "seq", "left")
    way_in = F.struct((F.col("seq") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("seq") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("ahead"))
    way_out = F.struct((F.col("seq") * 2 + 1).alias("arc"), F.coalesce(F.col("next") * 2, F.col("src") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("ahead"))
    arcs, turn = through_table(linked.select(F.inline(F.array(way_in, way_out))), f"{folder}/arcs-0"), 0
    while not arcs.where("to is not null").isEmpty():
        turn += 1
        onward = arcs.select(F.col("arc").alias("to"), F.col("to").alias("_to"), F.col("ahead").alias("_ahead"))
        # arcs that have reached the end stay; of the others no two have one successor
        moved = arcs.where("to is not null").join(onward, "to").select("arc", F.col("_to").alias("to"), (F.col("ahead") + F.col("_ahead")).alias("ahead"))
        arcs = through_table(moved.unionByName(arcs.where("to is null")), f"{folder}/arcs-{turn}")
    total = narrow.count()
    return arcs.where("arc % 2 = 0").select(F.floor(F.col("arc") / 2).alias("seq"), (F.lit(total) - F.col("ahead")).alias("place"))


def _result(walk: _Walk, earlier, pending_level, levels: int, dfs: bool) -> CrawlResult:
    spark, accessed_at = walk.spark, walk.accessed_at
    at = F.current_timestamp() if accessed_at is None else F.lit(accessed_at).cast("timestamp")
    own = [p for p in walk.done if not p.endswith("-earlier")]
    rows = walk.read(own, _SETTLED) if own else spark.createDataFrame([], _SETTLED)
    if pending_level is not None:
        rows = rows.unionByName(
            pending_level.withColumns({"status": F.lit(PENDING), "reached": F.lit(False)}), allowMissingColumns=True
        )
    # dense positions: after those of an earlier run, pre-order for depth-first
    top = None if earlier is None else earlier.agg(F.max("seq")).first()[0]
    start = 0 if top is None else top + 1
    if dfs:
        rows = rows.join(preorder(rows, walk.base), "seq").drop("seq").withColumn("seq", F.col("place") + start)
    else:
        rows = number_rows(rows.withColumnRenamed("seq", "_order"), ["_order"], "seq", start)
    pending = F.col("status") == PENDING
    view = rows.withColumn("fetched", F.when(~pending, format_accessed(at))).select(*FRONTIER_COLUMNS)
    if earlier is not None:
        view = earlier.select(*FRONTIER_COLUMNS).unionByName(view)
    extracted = rows.where("reached").select("url")
    named = extracted.withColumn("key", canonical_url("url"))
    gated = walk.facts.select("key", "rows").join(named, "key").select("url", "rows")
    if walk.lib.csv_cols:
        records = gated.select("url", F.inline("rows"))
    else:
        records = gated.select("url").limit(0)
    return CrawlResult(view, stamp(records, accessed_at), levels, walk.base)


def resume(pages: DataFrame, lib: Library, frontier: DataFrame, records: DataFrame, seeds: DataFrame | None = None, **options) -> CrawlResult:
    """Continue a saved run: its pending URLs first, then new seeds; new records are appended."""
    spark = pages.sparkSession
    seeds = spark.createDataFrame([], "seq long, url string") if seeds is None else seeds
    if "seq" not in frontier.columns:
        frontier = number_rows(frontier, ["url"], "seq")
    more = crawl(pages, lib, seeds, frontier=frontier, **options)
    fresh = more.records
    if dict(records.dtypes).get("dateaccessed") == "string":
        fresh = csv_view(fresh)
    return CrawlResult(more.frontier, append(records, fresh), more.levels, more.folder)
