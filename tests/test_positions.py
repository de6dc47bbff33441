"""Changed pages are fetched from their files by position; nothing but narrow rows is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from checks.tables import AT, FLAGSHIP, frontier_old
from pagetable import extract
from pagetable.operators.positions import fetch, file_of, has_positions, row_of
from pagetable.plans import refresh as rf
from pagetable.sources.tables import csv_view

SF = "/root/testdata/sf0.001"


@pytest.fixture
def pages(spark, tmp_path):
    """The pages in several files below a folder whose name has to be escaped, some URLs captured twice."""
    once = spark.read.parquet(f"{SF}/pages.parquet")
    again = once.where("page_id % 3 = 0").select((F.col("page_id") + 1000).alias("page_id"), "url", F.concat("html", F.lit("<p>")).alias("html"))
    folder = str(tmp_path / "a b")
    once.union(again).repartition(5).write.parquet(folder)
    return spark.read.parquet(folder)


def test_which_tables_have_positions(spark, pages, tmp_path):
    assert has_positions(pages) and has_positions(pages.where("page_id > 3").select("url", F.upper("html").alias("html")))
    for other in (pages.distinct(), pages.union(pages), pages.join(pages.select("url"), "url"), spark.range(3), pages.limit(3)):
        assert not has_positions(other)
    pages.write.json(str(tmp_path / "json"))
    assert not has_positions(spark.read.json(str(tmp_path / "json")))


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_fetch_finds_exactly_the_rows(pages, step):
    view = pages.where("page_id <> 4").select("url", "page_id", F.length("html").alias("n"))
    want = view.where("page_id % 5 = 0")
    places = want.select("url", file_of().alias("f"), row_of().alias("r"))
    got = [tuple(r) for part in fetch(view, places, "url", "f", "r", step) for r in part.collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_fetch_of_nothing(pages):
    places = pages.where("page_id < 0").select("url", file_of().alias("f"), row_of().alias("r"))
    assert [part.count() for part in fetch(pages, places, "url", "f", "r")] == [0]


def _refreshed(spark, pages):
    old = csv_view(extract(spark.read.parquet(f"{SF}/pages.parquet"), FLAGSHIP, "2023-01-01 00:00:00")).drop("_rows")
    out = rf.refresh(old, frontier_old(spark, SF), pages, FLAGSHIP, AT)
    return [sorted(map(str, df.collect())) for df in (out.records, out.frontier, out.changed)]


def test_refresh_by_position_equals_the_join(spark, pages, monkeypatch):
    monkeypatch.setattr(rf, "fetch", lambda *a: fetch(*a, 3))
    by_position = _refreshed(spark, pages)
    monkeypatch.setattr(rf, "has_positions", lambda df: False)
    assert by_position == _refreshed(spark, pages) and by_position[2]


def test_no_source_is_shuffled(spark, pages, monkeypatch):
    plans, through = {}, rf.through_table

    def noted(df, path):
        plans[path.rsplit("/")[-1]] = df._jdf.queryExecution().executedPlan().toString()
        return through(df, path)

    monkeypatch.setattr(rf, "through_table", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _refreshed(spark, pages)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans["rows-0"] and "SortMergeJoin" not in plans["rows-0"]
    for text in plans.values():
        for line, below in zip(text.split("\n"), text.split("\n")[1:]):
            if re.search(r"[ -]Exchange ", line):  # what a shuffle moves is what the step below it puts out
                assert not re.search(r"(Project|FileScan)[^\[]*\[(.*, )?html#\d+[,\]]", below), below
