"""The URL frontier as a table: lookups, set-union, limits, counts and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetable.functions.values import size_to_bytes
from pagetable.operators.joins import greatest_per_key, spread_join
from pagetable.operators.scan import first_rows, number_rows, ordered_table, prefix_scan
from pagetable.schemas import PENDING, STATUS_LABELS


def pending(frontier: DataFrame) -> DataFrame:
    return frontier.where(F.col("status") == PENDING)


def fetched(frontier: DataFrame) -> DataFrame:
    return frontier.where(F.col("status") != PENDING)


def failed(frontier: DataFrame) -> DataFrame:
    return frontier.where((F.col("status") < 0) & (F.col("status") != PENDING))


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count("*").alias("n"))


def status_label(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    out = F.when(s == 200, F.lit("ok"))
    for code, label in STATUS_LABELS.items():
        out = out.when(s == code, F.lit(label))
    return out.otherwise(F.concat(F.lit("http "), s.cast("string")))


def error_counts(frontier: DataFrame) -> DataFrame:
    """(kind, status, label, n) of every status other than 200 and pending."""
    wrong = frontier.where((F.col("status") != 200) & (F.col("status") != PENDING))
    kind = F.when(F.col("status") < 0, F.lit("network")).otherwise(F.lit("http"))
    return wrong.groupBy("status").agg(F.count("*").alias("n")).select(
        kind.alias("kind"), "status", status_label("status").alias("label"), "n"
    )


def frontier_counts(frontier: DataFrame) -> DataFrame:
    s = F.col("status")
    return frontier.agg(
        F.count("*").alias("size"),
        F.count_if(s == PENDING).alias("pending"),
        F.count_if(s != PENDING).alias("fetched"),
        F.count_if((s < 0) & (s != PENDING)).alias("errors"),
    )


def frontier_bytes(frontier: DataFrame) -> DataFrame:
    """Payload bytes of the table: text bytes plus 8 per number."""
    total = F.lit(0).cast("long")
    for name, kind in frontier.dtypes:
        size = F.octet_length(name).cast("long") if kind == "string" else F.lit(8).cast("long")
        total = total + F.coalesce(F.when(F.col(name).isNotNull(), size), F.lit(0))
    return frontier.agg(F.coalesce(F.sum(total), F.lit(0)).alias("bytes"))


def distinct_keys(frontier: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of different URLs and content hashes."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return frontier.agg(count("url").alias("urls"), count("hash").alias("hashes"))


def first_per_key(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """First row of every key; `order` is unique within a key, rows without a key are dropped.

    The winners are a narrow partial aggregate. The rows then meet them on (order, key), which
    spreads evenly however many rows share one key, and wide columns are never aggregated.
    """
    winners = rows.groupBy(key).agg(F.min(order).alias(order))
    return rows.join(winners, [order, key], "left_semi").select(*rows.columns)


def first_seen(pages: DataFrame, key: str = "hash", order: str = "seq") -> DataFrame:
    """(key, order, n_copies): where each content was met first."""
    return pages.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("n_copies"))


def first_links(links: DataFrame, order=("seq",)) -> DataFrame:
    """Each URL once: its first row in `order`. Links are narrow rows, reduced before the shuffle."""
    others = [c for c in links.columns if c != "url" and c not in order]
    best = links.groupBy("url").agg(F.min(F.struct(*order, *others)).alias("_f"))
    return best.select(*[F.col("url") if c == "url" else F.col(f"_f.{c}").alias(c) for c in links.columns])


def new_links(links: DataFrame, frontier: DataFrame, order=("seq",)) -> DataFrame:
    """Links whose URL is not queued yet, each once (its first in `order`)."""
    return first_links(links, order).join(frontier.select("url"), "url", "left_anti").select(*links.columns)


def unseen_content(pages: DataFrame, frontier: DataFrame, key: str = "hash", order: str = "seq") -> DataFrame:
    """Pages with a content hash that neither the frontier nor an earlier page has.

    Both sides are reduced to one narrow row per hash before they meet.
    """
    known = frontier.where(F.col(key).isNotNull()).select(key).distinct()
    winners = pages.groupBy(key).agg(F.min(order).alias(order)).join(known, key, "left_anti")
    return pages.join(winners, [order, key], "left_semi").select(*pages.columns)


def lookup(keys: DataFrame, frontier: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """Each key with its first frontier row, NULLs when there is none."""
    return spread_join(keys, first_per_key(frontier, key, order), key)


def frontier_order(frontier: DataFrame, traversal: str = "bfs") -> DataFrame:
    """Pending URLs in the order they would be taken."""
    seq = F.col("seq")
    return pending(frontier).orderBy(seq.desc() if traversal.lower() == "dfs" else seq.asc())


def queue_places(frontier: DataFrame, traversal: str = "bfs") -> DataFrame:
    """+ `place`: the turn (from 0) at which each pending URL would be taken."""
    order = -F.col("seq") if traversal.lower() == "dfs" else F.col("seq")
    return number_rows(pending(frontier).withColumn("_turn", order), ["_turn"], "place").drop("_turn")


def from_position(rows: DataFrame, position: int, order: str = "seq") -> DataFrame:
    """Rows from a 0-based position on; the order column must be dense from 0 (see `number_rows`)."""
    return rows.where(F.col(order) >= position)


def max_pages(log: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first n processed pages; no limit unless n > 0."""
    return first_rows(log, [seq], n) if n > 0 else log


def within_size(candidates: DataFrame, current: int, limit: int, seq: str = "seq") -> DataFrame:
    """Candidates, in order, that a queue of at most `limit` URLs still takes (negative: no limit)."""
    if limit < 0:
        return candidates
    return first_rows(candidates, [seq], max(limit - current, 0))


def within_bytes(candidates: DataFrame, current: int, limit, seq: str = "seq", url: str = "url") -> DataFrame:
    """Candidates accepted while the bytes queued before them stay below the limit ('8M', 0 or less: none)."""
    cap = size_to_bytes(limit)
    if cap <= 0:
        return candidates
    size = F.octet_length(url).cast("long")
    scanned = prefix_scan(candidates, seq, {"_before": ("sum", size)}, inclusive=False)
    return scanned.where(F.coalesce("_before", F.lit(0)) + F.lit(current) < cap).drop("_before")


def add_urls(frontier: DataFrame, urls: DataFrame, max_size: int = -1, max_bytes="-1") -> DataFrame:
    """Frontier with the new URLs of `urls` (seq, url) appended as pending, as far as the limits allow.

    New rows get dense `seq` values after the frontier's largest.
    """
    fresh = new_links(urls.select("seq", "url"), frontier)
    state = frontier.agg(
        F.count("*").alias("n"), F.max("seq").alias("top"), F.sum(F.octet_length("url")).alias("bytes")
    ).first()
    top = -1 if state["top"] is None else state["top"]
    numbered = number_rows(fresh.select("seq", "url"), ["seq", "url"], "_rank").select(
        "url", (F.col("_rank") + top + 1).alias("seq")
    )
    accepted = within_size(numbered, state["n"], max_size)
    accepted = within_bytes(accepted, state["bytes"] or 0, max_bytes)
    typed = accepted.select(
        *[
            F.col(f.name).cast(f.dataType)
            if f.name in ("url", "seq")
            else (F.lit(PENDING).cast(f.dataType) if f.name == "status" else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in frontier.schema.fields
        ]
    )
    return frontier.unionByName(typed)


def update_frontier(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Non-NULL cells of `results` replace those of the frontier; of several rows for a url the greatest counts."""
    cells = [c for c in results.columns if c != "url" and c in frontier.columns]
    joined = frontier.join(greatest_per_key(results, "url", cells), "url", "left")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cells else F.col(c) for c in frontier.columns]
    )


def url_history(captures: DataFrame, seq: str = "seq", url: str = "url", state: str = "hash") -> DataFrame:
    """Captures with the previous and next state of the same URL, in `seq` order (unique per URL).

    Captures are stored in (url, seq) order; neighbours meet inside the stored partitions, and one row per partition
    joins their ends. A URL with a large part of all captures fills several partitions like any other rows.
    """
    ordered = ordered_table(captures.select(url, seq, state), [url, seq], "_mid")
    placed = ordered.withColumn("_part", F.shiftright("_mid", 33))
    here, inside = F.struct(F.col(url).alias("u"), F.col(state).alias("s")), Window.partitionBy("_part").orderBy("_mid")
    near = placed.withColumns({"_prev": F.lag(here).over(inside), "_next": F.lead(here).over(inside)})
    ends = placed.groupBy("_part").agg(F.min_by(here, "_mid").alias("_first"), F.max_by(here, "_mid").alias("_last"))
    across = Window.orderBy("_part")  # one row per partition
    edges = ends.select("_part", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    met = near.join(edges, "_part").withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    states = met.select(
        url,
        seq,
        F.when(F.col("_prev.u") == F.col(url), F.col("_prev.s")).alias(f"prev_{state}"),
        F.when(F.col("_next.u") == F.col(url), F.col("_next.s")).alias(f"next_{state}"),
    )
    return captures.join(states, [url, seq]).select(*captures.columns, f"prev_{state}", f"next_{state}")
