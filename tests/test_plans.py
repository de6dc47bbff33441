"""The physical plans stay the ones that scale."""

import pytest
from pyspark.sql import functions as F

from checks.tables import AT, FLAGSHIP
from pagetable import extract, extract_links, parse_dom, rule_stats
from pagetable.operators import frontier as fr
from pagetable.operators.runlog import running_hit_rate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def test_extract_parses_once_and_never_shuffles(pages):
    text = plan(extract(pages, FLAGSHIP, AT))
    assert text.count("MapInArrow") == 1
    assert "Exchange" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_source_stops_at_the_parse(pages):
    text = plan(extract(pages, FLAGSHIP, AT))
    above = text.split("MapInArrow")[0]
    assert "html#" not in above and "page_id" not in text


def test_url_patterns_filter_below_the_parse(pages):
    only_english = FLAGSHIP.only("title")
    text = plan(extract(pages, only_english, AT))
    below = text.split("MapInArrow")[1]
    assert "Filter" in below and "/en/" in below


def test_links_parse_once(pages):
    text = plan(extract_links(pages, FLAGSHIP))
    assert text.count("MapInArrow") == 1 and "Exchange" not in text


def test_statistics_shuffle_one_row_per_task(pages):
    text = plan(rule_stats(pages, FLAGSHIP))
    assert text.count("Exchange SinglePartition") == 1 and "partial_" in text and text.count("MapInArrow") == 1


def test_first_per_key_aggregates_narrow_rows(spark):
    wide = spark.range(10).select(F.col("id").alias("seq"), F.lit("h").alias("hash"), F.lit("body").alias("html"))
    text = plan(fr.first_per_key(wide, "hash"))
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_running_rate_reads_the_log_once(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("seq"), F.lit(1).alias("hit")).write.parquet(str(tmp_path / "log"))
    text = plan(running_hit_rate(spark.read.parquet(str(tmp_path / "log"))))
    # rows were windowed by block when they were stored; here only block totals meet in one task
    assert str(tmp_path / "log") not in text and text.count("FileScan parquet") <= 4


def test_joins_read_the_left_side_once(spark, tmp_path):
    from pagetable.operators.records import remove_records, update_records

    spark.range(10).select(F.col("id").cast("string").alias("url"), F.lit("x").alias("t")).write.parquet(str(tmp_path / "rows"))
    rows, new = spark.read.parquet(str(tmp_path / "rows")), spark.createDataFrame([("1", "y")], "url string, t string")
    for out in (update_records(rows, new), remove_records(rows, new)):
        assert plan(out).count(str(tmp_path / "rows")[-30:]) <= 1


def test_selection_stays_in_the_jvm(pages):
    from pagetable import select

    text = plan(parse_dom(pages.select("html")).select(F.size(select("nav > ul > li:not(:nth-child(1)) a[href]"))))
    assert text.count("MapInArrow") == 1 and "EvalPython" not in text
