"""Change detection and merging of re-extracted pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetable.functions.http import header_get
from pagetable.functions.values import content_hash, format_accessed
from pagetable.operators.frontier import update_frontier
from pagetable.operators.joins import spread_join
from pagetable.operators.positions import fetch, file_of, has_positions, row_of
from pagetable.operators.quality import any_present, passes_gate
from pagetable.operators.records import append, remove_records, update_records
from pagetable.plans.checkpoints import run_folder, through_table
from pagetable.plans.extraction import page_rows, parse_active, stamp
from pagetable.plans.library import Library
from pagetable.schemas import PENDING
from pagetable.sources.tables import csv_view


@dataclass(frozen=True)
class RefreshResult:
    """`folder` holds the run's intermediate tables; `plans.checkpoints.drop_folder` removes it after use."""

    records: DataFrame
    frontier: DataFrame
    changed: DataFrame
    folder: str


def page_states(pages: DataFrame) -> DataFrame:
    """(url, status, lastmodified, hash): the latest capture of each URL, by `seq` or `page_id` where there is one."""
    return _states(pages).select("url", "status", "lastmodified", "hash")


def _captured(pages: DataFrame):
    return next((F.col(c).cast("long") for c in ("seq", "page_id") if c in pages.columns), F.lit(0).cast("long"))


def _states(pages: DataFrame, placed: bool = False) -> DataFrame:
    """The latest capture of each URL; `placed` adds its position in its file (_file, _row), which settles ties."""
    has_headers = "headers" in pages.columns
    place = [file_of().alias("_file"), row_of().alias("_row")] if placed else []
    rows = pages.select(
        "url",
        _captured(pages).alias("_at"),
        (F.col("status") if "status" in pages.columns else F.lit(200)).alias("status"),
        (header_get("headers", "Last-Modified") if has_headers else F.lit("")).alias("lastmodified"),
        content_hash("html").alias("hash"),
        *place,
    )
    cells = ["_at", "hash", "status", "lastmodified", *(["_file", "_row"] if placed else [])]
    latest = rows.groupBy("url").agg(F.max(F.struct(*cells)).alias("_s"))
    return latest.select("url", *[f"_s.{c}" for c in cells])


def records_with_frontier(records: DataFrame, frontier: DataFrame) -> DataFrame:
    """Each record with its URL's frontier state (NULLs when the URL is unknown)."""
    state = frontier.select("url", *[F.col(c).alias(f"q_{c}") for c in ("status", "lastmodified", "hash")])
    return spread_join(records, state, "url")


def missing_urls(records: DataFrame, frontier: DataFrame) -> DataFrame:
    return records.select("url").distinct().join(frontier.select("url"), "url", "left_anti")


def changed_pages(states: DataFrame, frontier: DataFrame) -> DataFrame:
    """Fetched pages whose Last-Modified or, failing that, content hash differs from the frontier's.

    A URL that the frontier does not know counts as changed.
    """
    old = frontier.select("url", F.col("lastmodified").alias("_lm"), F.col("hash").alias("_h"))
    same_date = (F.col("lastmodified") != "") & F.col("lastmodified").eqNullSafe(F.col("_lm"))
    same_hash = F.col("hash").eqNullSafe(F.col("_h"))
    joined = states.where(F.col("status") == 200).join(old, "url", "left")
    return joined.where(~F.coalesce(same_date, F.lit(False)) & ~same_hash).select(*states.columns)


def refresh(
    records: DataFrame, frontier: DataFrame, pages_now: DataFrame, lib: Library, accessed_at=None, gate: bool = False
) -> RefreshResult:
    """Re-extract the pages of `records` that changed and merge the results.

    A page that gives a record overwrites the known cells of all rows of its URL; a page that gives
    a record list replaces the rows of its URL. `gate=True` applies the library's constraints.
    Only hashes and dates of all pages are compared; sources are read again for changed pages only. Of a Parquet table
    (below filters and projections) they are fetched by file and row number, so no source is shuffled (`positions.fetch`);
    pages computed otherwise meet the changed URLs in a join.
    """
    with run_folder(records.sparkSession, "refresh") as base:
        return _refresh(records, frontier, pages_now, lib, accessed_at, gate, base)


def _refresh(records, frontier, pages_now, lib, accessed_at, gate, base) -> RefreshResult:
    tracked = records.select("url").distinct()
    absent = missing_urls(records, frontier)
    placed = has_positions(pages_now)
    states = _states(pages_now, placed).join(tracked, "url", "left_semi")
    changed = through_table(changed_pages(states, frontier), f"{base}/changed")
    if placed:
        sources = fetch(pages_now, changed.select("url", "_file", "_row"), "url", "_file", "_row")
    else:
        latest = pages_now.select("url", "html", _captured(pages_now).alias("_at"), content_hash("html").alias("hash"))
        met = latest.join(changed.select("url", "_at", "hash"), ["url", "_at", "hash"], "left_semi")
        sources = [met.dropDuplicates(["url"])]  # the same capture twice is one
    shaped = _extracted(sources, lib, base)
    flat = shaped.select("url", "_is_list", F.inline_outer("_rows"))
    if gate:
        keep = passes_gate(flat.schema, lib.csv_cols, lib.required, lib.min_filled)
    else:
        keep = F.col("_is_list") | any_present(lib.csv_cols)
    good = flat.where(keep)
    cells = [c for c in records.columns if c in lib.csv_cols]
    singles = good.where(~F.col("_is_list")).select("url", *cells)
    if not gate:
        # every changed page that is no list is stamped, even if nothing was found on it
        lists = shaped.where("_is_list").select("url")
        touched = changed.select("url").join(lists, "url", "left_anti")
        singles = touched.join(singles, "url", "left")
    listed = good.where("_is_list").select("url", *cells)
    stamped_singles, stamped_lists = stamp(singles, accessed_at), stamp(listed, accessed_at)
    if dict(records.dtypes).get("dateaccessed") == "string":
        stamped_singles, stamped_lists = csv_view(stamped_singles), csv_view(stamped_lists)
    updated = update_records(records, stamped_singles)
    replaced = shaped.where("_is_list").select("url")
    merged = append(remove_records(updated, replaced), stamped_lists.select("dateaccessed", "url", *cells))
    at = F.current_timestamp() if accessed_at is None else F.lit(accessed_at).cast("timestamp")
    added = absent.select(
        *[
            F.col("url") if f.name == "url" else (F.lit(PENDING) if f.name == "status" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in frontier.schema.fields
        ]
    )
    results = changed.select("url", "status", "lastmodified", "hash")
    if "fetched" in frontier.columns:
        results = results.withColumn("fetched", format_accessed(at))
    known = changed.drop("_at", "_file", "_row")
    return RefreshResult(merged, update_frontier(frontier.unionByName(added), results), known, base)


def _extracted(sources, lib: Library, base: str) -> DataFrame:
    """(url, _rows, _is_list) of the pages of all steps, each stored before the next one is read."""
    paths = []
    for step in sources:
        rows = page_rows(parse_active(step.select("url", "html"), lib), lib).select("url", "_rows", "_is_list")
        paths.append(f"{base}/rows-{len(paths)}")
        stored = through_table(rows, paths[-1])
    return stored.sparkSession.read.schema(stored.schema).parquet(*paths)
