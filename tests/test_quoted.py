"""Delimited files read by blocks equal Spark's reader of whole files."""

import random
import re

import pytest
from pyspark.sql import types as T

from pagetable.plans.library import Library
from pagetable.sources import quoted
from pagetable.sources import tables as tb

COLS = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b c", "d")])


@pytest.fixture
def small_blocks(spark):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


def both(spark, path, sep=";"):
    options = dict(sep=sep, header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)
    want = spark.read.schema(COLS).options(**options).csv(path)
    got = quoted.read_quoted(spark, path, COLS, sep)
    return sorted(map(repr, got.collect())), sorted(map(repr, want.collect()))


def write(folder, name, records, end="\n", last=True):
    quote = lambda c: '"' + c.replace('"', '""') + '"' if c is not None else ""
    text = end.join([";".join(COLS.names)] + [";".join(map(quote, r)) for r in records]) + (end if last else "")
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())


def test_random_files(spark, tmp_path, small_blocks):
    rng = random.Random(5)
    pieces = ["x", "é", "\n", "\n\n", '"', '""', ";", " ", "word", "\r\n", "a\nb", "ß" * 40, "\t"]
    cell = lambda: None if rng.random() < 0.1 else "".join(rng.choices(pieces, k=rng.randrange(7)))
    for i in range(6):
        # a quoted last cell, so that a line of three empty cells is never blank
        write(tmp_path / "f", f"{i}.csv", [(cell(), cell(), cell() or "z") for _ in range(rng.randrange(40))], last=i % 2 == 0)
    got, want = both(spark, str(tmp_path / "f"))
    assert got == want and len(got) > 30


def test_one_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f'line "{i}"; more' for i in range(400))
    write(tmp_path / "f", "a.csv", [("1", "x", "y"), ("2", long, "z"), ("3", "\n" * 300, long), ("4", None, "end")])
    got, want = both(spark, str(tmp_path / "f"))
    assert got == want and len(got) == 4
    assert quoted._lines(spark, str(tmp_path / "f")).rdd.getNumPartitions() > 50


def test_other_line_ends_blank_lines_and_short_rows(spark, tmp_path, small_blocks):
    write(tmp_path / "f", "a.csv", [("1", "x\r\ny", "z"), ("2", "", "q")], end="\r\n")
    (tmp_path / "f" / "b.csv").write_text('a;b c;d\n\n1;2;3\n\n\n4;5\n6;7;8;9\nplain;"q""q";\n')
    (tmp_path / "f" / "c.csv").write_text("")
    (tmp_path / "f" / "d.csv").write_text("a;b c;d\n")
    got, want = both(spark, str(tmp_path / "f"))
    assert got == want and len(got) == 6


def test_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("a;x;d\n1;2;3\n")
    with pytest.raises(Exception, match="header does not match"):
        quoted.read_quoted(spark, str(tmp_path / "f"), COLS, ";").collect()


def test_records_of_large_files_are_read_by_blocks(spark, tmp_path, small_blocks):
    lib = Library.from_dict({"csvLineFormat": ["t", "u"], "library": []})
    recs = spark.createDataFrame([("x", f"u{i}", f'a "{i}"\n;' * (i % 5), None if i % 3 else "") for i in range(400)], "dateaccessed string, url string, t string, u string")
    tb.write_records(recs.coalesce(2), str(tmp_path / "r"))
    assert quoted.largest_file(spark, str(tmp_path / "r")) > 64 * 97
    by_block = tb.read_records(spark, str(tmp_path / "r"), lib)
    whole = tb.read_records(spark, str(tmp_path / "r"), lib, by_block=False)
    assert by_block._jdf.queryExecution().toString().count("Window") and "Window" not in whole._jdf.queryExecution().toString()
    assert sorted(map(repr, by_block.collect())) == sorted(map(repr, whole.collect())) and by_block.count() == 400


def test_lines_move_by_block_only(spark, tmp_path):
    write(tmp_path / "f", "a.csv", [("1", "x", "y")] * 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = quoted.quoted_records(spark, str(tmp_path / "f"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "EvalPython" not in text and "MapIn" not in text
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert keys and all(re.fullmatch(r"file#\d+(, (block|_groupingexpression)#\d+L)?", k) for k in keys)
