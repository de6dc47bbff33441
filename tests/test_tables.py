"""Frontier, records, run log, change detection, files and streams on small tables."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetable import Library, extract, library_catalog, load_library, load_rules, read_pages, read_seeds, refresh, stream_extract, stream_pages
from pagetable.functions.values import content_hash
from pagetable.operators import frontier as fr
from pagetable.operators import records as rec
from pagetable.operators import runlog as rl
from pagetable.operators.scan import first_rows, number_rows, prefix_scan
from pagetable.plans.checkpoints import checkpoint_dir
from pagetable.schemas import CAPTURES, PAGES
from pagetable.sources import tables as tb
from pagetable.sources.libraries import describe_library, read_libraries
from pagetable.streaming import pages as sp

AT = "2024-05-06 07:08:09"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- running aggregates ------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_prefix_scan(spark, bits):
    rnd = random.Random(bits)
    seqs = sorted(rnd.sample(range(500), 60) + [10**6, 2**40])
    data = [(s, rnd.choice([None, 1, 2, 5]), rnd.choice("abc")) for s in seqs]
    df = spark.createDataFrame(data, "seq long, v int, h string")
    specs = {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "m": ("max", F.col("v")), "l": ("max", F.struct("seq", "h"))}
    for inclusive in (True, False):
        got = rows(prefix_scan(df, "seq", specs, inclusive, bits).select("seq", "s", "c", "m", "l.h"), "seq")
        for i, row in enumerate(got):
            seen = data[: i + 1 if inclusive else i]
            values = [v for _, v, _ in seen if v is not None]
            want = (data[i][0], sum(values) if values else None, len(values), max(values, default=None), seen[-1][2] if seen else None)
            assert row == want


def test_numbering(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert rows(number_rows(df, ["k"], "n", 5), "k") == [(k, k + 5) for k in range(1000)]
    assert sorted(r[0] for r in first_rows(df, ["k"], 10).collect()) == list(range(10))


def test_limits_filter_by_the_last_key(spark):
    df = spark.range(0, 100, 1, 4).select((99 - F.col("id")).alias("k"), (F.col("id") % 7).alias("j"))
    assert sorted(r[0] for r in first_rows(df, ["k"], 30).collect()) == list(range(30))
    want = sorted((i % 7, 99 - i) for i in range(100))[:30]
    assert sorted((r["j"], r["k"]) for r in first_rows(df, ["j", "k"], 30).collect()) == want
    assert first_rows(df, ["k"], 0).count() == 0 and first_rows(df, ["k"], 500).count() == 100


@pytest.mark.parametrize("n", [1, 2, 499, 500, 501, 1207, 1999, 2000, 2001])
def test_first_rows_by_counting(spark, n):
    # half of the rows share one key, some have none, and small ranges force many rounds
    data = [(None if i % 40 == 0 else "tie" if i % 2 else f"k{i * 7 % 1000}", i % 3 if i % 5 else None) for i in range(2000)]
    df = spark.createDataFrame(data, "a string, b int").repartition(5)
    ordered = df.orderBy("a", "b").collect()
    got = sorted(map(str, first_rows(df, ["a", "b"], n, bins=3, small=10).collect()))
    reach = next((i for i in range(n, 2000) if ordered[i] != ordered[n - 1]), 2000) if n <= 2000 else 2000
    assert got == sorted(map(str, ordered[:reach]))


def test_first_rows_shuffles_no_keys(spark, tmp_path, monkeypatch):
    from pagetable.operators import scan

    seen, through = [], scan.through_table
    monkeypatch.setattr(scan, "through_table", lambda df, path: seen.append(df._jdf.queryExecution().executedPlan().toString()) or through(df, path))
    df = spark.range(500).selectExpr("(id * 37) % 500 AS k", "id")
    out = scan.first_rows(df, ["k"], 123, bins=4, small=20)
    assert sorted(r["k"] for r in out.collect()) == list(range(123)) and len(seen) == 1
    assert "Exchange" not in seen[0] and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# --- run log -----------------------------------------------------------------------------------


def test_streaks_and_stop(spark):
    rnd = random.Random(3)
    data = [(i * 3, rnd.randrange(2), rnd.random() < 0.8) for i in range(200)]
    df = spark.createDataFrame(data, "seq long, hit int, reached boolean")
    hits = streak = 0
    want, stop = [], None
    for n, (seq, hit, reached) in enumerate(data):
        rate = hits / n if n else 0.0
        if reached:
            streak = streak + 1 if rate < 0.5 else 0
            if stop is None and streak >= 4:
                stop = seq
        want.append((seq, rate, streak))
        hits += hit
    got = rl.below_rate_streak(df, 0.5, 4, reached="reached")
    assert rows(got.select("seq", "hit_rate", "streak"), "seq") == want
    kept = rl.until_rate_stop(df, 0.5, 4, reached="reached")
    assert kept.agg(F.max("seq")).first()[0] == stop
    assert rl.until_rate_stop(df, -1.0, 4).count() == 200


def test_speed_hosts_and_sums(spark):
    data = [(i, f"h{i // 2}", float(i + 1), 1024, i % 2) for i in range(7)]
    df = spark.createDataFrame(data, "seq long, host string, handling_s double, bytes long, hit int")
    assert [r[-1] for r in rows(rl.sampled_speed(df, 3), "seq")] == [1, 1.5, 2, 4, 4.5, 5, 7]
    assert [r[-1] for r in rows(rl.same_host_as_previous(df), "seq")] == [False, True, False, True, False, True, False]
    assert rl.throughput(df, elapsed_s=2.0).first()[:] == (0.25, 3.5)
    assert rl.run_summary(df, queue_size=9).first()[:] == ("0:00:28", 7, 3, 9, 0.25, 0.25, 3 / 7)
    empty = df.where("false")
    assert rl.hit_rate(empty).first()[0] == 0.0 and rl.run_summary(empty).first()["hitrate"] == 0.0


# --- frontier and records ----------------------------------------------------------------------


def frontier_of(spark, *cells):
    return spark.createDataFrame(cells, "url string, seq long, status int, hash string, lastmodified string")


def test_add_urls_respects_limits(spark):
    f = frontier_of(spark, ("a", 0, 200, "1", ""), ("b", 4, -1, None, None))
    new = spark.createDataFrame([(3, "c"), (1, "d"), (2, "a"), (5, "d"), (9, "e")], "seq long, url string")
    assert [(r["url"], r["seq"], r["status"]) for r in fr.add_urls(f, new).orderBy("seq").collect()][2:] == [("d", 5, -1), ("c", 6, -1), ("e", 7, -1)]
    assert [r["url"] for r in fr.add_urls(f, new, max_size=3).orderBy("seq").collect()] == ["a", "b", "d"]
    assert [r["url"] for r in fr.add_urls(f, new, max_bytes="4").orderBy("seq").collect()] == ["a", "b", "d", "c"]
    assert fr.add_urls(f.where("false"), new).count() == 4


def test_hot_content_keeps_one_page(spark):
    pages = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("hash"))
    assert fr.first_per_key(pages, "hash").count() == 2001
    seen = pages.where("seq < 100 and hash <> 'hot'")
    kept = fr.unseen_content(pages, seen)
    assert kept.where("hash = 'hot'").first()["seq"] == 0 and kept.where("seq < 100").count() == 1


@pytest.mark.parametrize("how", ["left", "left_anti", "left_semi", "inner"])
def test_spread_join_equals_a_plain_join(spark, how):
    from pagetable.operators.joins import spread_join

    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2500).alias("k"), F.lit("same").alias("v"))
    right = spark.range(-1, 1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert sorted(rows(spread_join(left, right, "k", how)), key=str) == sorted(rows(left.join(right, "k", how)), key=str)
    empty = left.where("false")
    assert spread_join(empty, right, "k", how).count() == 0


def test_url_history(spark):
    data = [(0, "a", "1"), (3, "a", "2"), (1, "b", "1"), (5, "a", None), (2, "c", "9")]
    got = fr.url_history(spark.createDataFrame(data, "seq long, url string, hash string"))
    assert rows(got, "seq") == [(0, "a", "1", None, "2"), (1, "b", "1", None, None), (2, "c", "9", None, None), (3, "a", "2", "1", None), (5, "a", None, "2", None)]


def test_record_tables(spark):
    base = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "url string, v string, ord long")
    new = spark.createDataFrame([("a", "9", "x")], "url string, v string, unknown string")
    assert rows(rec.update_records(base, new), "ord") == [("a", "9", 0), ("b", "2", 1), ("a", "9", 2)]
    assert rows(rec.remove_records(base, new)) == [("b", "2", 1)]
    assert [r[0] for r in rows(rec.insert_at(base, 1, new.select("url", "v", F.lit(0).cast("long").alias("ord"))), "ord")] == ["a", "a", "b", "a"]
    lists = rec.replace_record_lists(base, new)
    assert sorted(r[1] for r in lists.collect()) == ["2", "9"] and lists.columns == base.columns
    assert rows(rec.renumber(base.where("ord <> 1"), ["ord"]).select("v", "ord"), "ord") == [("1", 0), ("3", 1)]


# --- change detection --------------------------------------------------------------------------

LIB = Library.from_dict(
    {
        "csvLineFormat": ["t", "c"],
        "requiredFilledFields": ["t"],
        "library": [
            {"ruleName": "t", "ruleURLActivationCondition": ["one"], "ruleCSSSelector": "h1", "ruleTargetAttribute": "text"},
            {"ruleName": "rows", "ruleURLActivationCondition": ["many"], "ruleCSSSelector": "li", "ruleTargetAttribute": "text", "ruleReturnsMore": True,
             "rulePostCSSSelector": ["b"], "ruleReturnedValueNames": ["t"]},
        ],
    }
)


def test_refresh(spark):
    old_rows = [
        ("x", "one/same-hash", "old", "k"), ("x", "one/same-date", "old", "k"), ("x", "one/changed", "old", "k"), ("x", "one/changed", "old2", "k2"),
        ("x", "many/changed", "old", None), ("x", "many/changed", "old", None), ("x", "one/unknown", "old", "k"), ("x", "one/error", "old", "k"),
        ("x", "one/gone", "old", "k"), ("x", "other", "old", "k"),
    ]
    records = spark.createDataFrame(old_rows, "dateaccessed string, url string, t string, c string")
    page = "<h1>new</h1>"
    now = [
        (1, "one/same-hash", 200, {}, page), (2, "one/same-date", 200, {"last-modified": "D"}, page), (3, "one/changed", 200, {"Last-Modified": "E"}, page),
        (4, "many/changed", 200, {}, "<li><b>1</b><li><b>2</b><li>"), (5, "one/unknown", 200, {}, "<p>"), (6, "one/error", 500, {}, page),
        (7, "other", 200, {}, "<h1>?</h1>"), (8, "one/untracked", 200, {}, page),
    ]
    pages = spark.createDataFrame(now, CAPTURES)
    digest = spark.range(1).select(content_hash(F.lit(page))).first()[0]
    frontier = frontier_of(
        spark, ("one/same-hash", 0, 200, digest, ""), ("one/same-date", 1, 200, "?", "D"), ("one/changed", 2, 200, digest + "?", "D"),
        ("many/changed", 3, -7, None, None), ("one/error", 4, 200, "?", ""), ("other", 5, 200, "?", ""), ("one/untracked", 6, 200, "?", ""),
    )
    out = refresh(records, frontier, pages, LIB, AT)
    new = "06/05/2024 07:08:09"
    assert sorted(rows(out.records), key=str) == sorted(
        [
            ("x", "one/same-hash", "old", "k"), ("x", "one/same-date", "old", "k"), (new, "one/changed", "new", "k"), (new, "one/changed", "new", "k2"),
            (new, "many/changed", "1", None), (new, "many/changed", "2", None), (new, "many/changed", "", None),
            (new, "one/unknown", "", "k"), ("x", "one/error", "old", "k"), ("x", "one/gone", "old", "k"), (new, "other", "old", "k"),
        ],
        key=str,
    )
    state = {r["url"]: (r["status"], r["lastmodified"]) for r in out.frontier.collect()}
    assert state["one/changed"] == (200, "E") and state["many/changed"] == (200, "") and state["one/gone"] == (-1, None)
    assert state["one/unknown"] == (200, "") and state["one/error"] == (200, "") and len(state) == 9
    gated = refresh(records, frontier, pages, LIB, AT, gate=True).records
    assert sorted(r["t"] for r in gated.where("url = 'many/changed'").collect()) == ["1", "2"]
    assert [r["t"] for r in gated.where("url = 'one/unknown'").collect()] == ["old"]


# --- files -------------------------------------------------------------------------------------

RELAXED = r"""
{ # a library in the relaxed form
  "allowedMinimumFilled": 0.8
  "library": [ {
      "ruleRemoveChars": ["$", "\""]
      "ruleCSSSelector": "#first h1", "ruleTargetAttribute": "text",
      "ruleURLActivationCondition": ["garden\.example/(?!old\/z).*[a-f]$", "a\\b"]
      "ruleReturnsMore": False
      "ruleName": "title",
    }

    # second
    { "ruleReturnedMatchPos": 2 # "ruleTarget": "js"
      "ruleName": "links", "ruleReturnsMore": True
      "rulePreconditions": [
        { "ecTextCondition" : "(x{2,}|[q-s])",
          "ecCSSSelector" : "a" } ]
    } ]
  "renderPages":False,
  "csvLineFormat":["title", "links"], "libraryDescription": "Plants # and more"   # trailing
}
"""


def test_library_files(spark, tmp_path):
    (tmp_path / "a.rules").write_text(RELAXED)
    (tmp_path / "b.json").write_text('{"libraryDescription": "plain", "library": [{"ruleName": "x"}], "requiredFilledFields": ["x"]}')
    (tmp_path / "c.rules").write_text("not a library")
    lib = load_library(spark, str(tmp_path / "a.rules"))
    title, links = lib.rules
    assert lib.descr == "Plants # and more" and lib.csv_cols == ("title", "links") and lib.min_filled == 0.8 and lib.required == ()
    assert title.url_patterns == (r"garden\.example/(?!old\/z).*[a-f]$", r"a\b") and title.css == "#first h1"
    assert title.remove == ("$", '"') and title.match_pos == -1 and not title.returns_more and title.pre_type == "ANY"
    assert links.pre[0].regex == r"(x{2,}|[q-s])" and links.returns_more and links.match_pos == 2 and links.target == "html"
    assert rows(library_catalog(spark, str(tmp_path)), "file_name") == [("a.rules", "Plants # and more", 2), ("b.json", "plain", 1)]
    rules = load_rules(spark, str(tmp_path))
    assert [(r["rule_pos"], r["rule_name"], r["match_pos"]) for r in rules.orderBy("lib", "rule_pos").collect()] == [(0, "title", -1), (1, "links", 2), (0, "x", -1)]
    told = describe_library(rules).orderBy("lib", "rule_pos").collect()
    assert [(r["n_preconditions"], r["cond_css"]) for r in told] == [(0, None), (1, "a"), (0, None)]
    with pytest.raises(ValueError):
        load_library(spark, str(tmp_path / "c.rules"))
    assert read_libraries(spark, str(tmp_path)).where("unreadable").count() == 1


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("http://b\r\nftp://c\nhttp://a\n\nhttp://b\n")
    assert rows(read_seeds(spark, str(tmp_path / "seeds.txt")), "seq") == [(0, "http://b"), (1, "ftp://c"), (2, "http://a")]
    assert rows(read_seeds(spark, "http://x")) == [(0, "http://x")]
    assert rows(read_seeds(spark, ["u", "v", "u"]), "seq") == [(0, "u"), (1, "v")]


def test_page_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.html").write_text("<h1>a\nb</h1>")
    page = read_pages(spark, str(tmp_path), format="files").first()
    assert page["url"].endswith("/d/one.html") and page["html"] == "<h1>a\nb</h1>"


def test_frontier_and_record_files(spark, tmp_path):
    f = spark.createDataFrame(
        [("http://a;\"b\"", "06/05/2024 07:08:09", 200, "text/html", 12, "", "h"), ("http://c", None, -1, None, None, None, None)],
        "url string, fetched string, status int, contenttype string, contentlength long, lastmodified string, hash string",
    )
    path = str(tmp_path / "frontier")
    tb.write_frontier(f, path)
    assert {(r["url"], r["status"], r["contentlength"]) for r in tb.read_frontier(spark, path).collect()} == {("http://a;\"b\"", 200, 12), ("http://c", -1, None)}
    assert tb.read_frontier(spark, path, statuses=[-1]).count() == 1
    assert tb.read_frontier(spark, str(tmp_path / "none")).count() == 0
    lib = Library.from_dict({"csvLineFormat": ["t", "tags"], "library": []})
    recs = spark.createDataFrame([("u", 'a "b";\nc', ["x", "y"])], "url string, t string, tags array<string>")
    recs = recs.select(F.lit(AT).cast("timestamp").alias("dateaccessed"), "url", "t", "tags")
    tb.write_records(recs, str(tmp_path / "records"))
    back = tb.read_records(spark, str(tmp_path / "records"), lib)
    assert rows(back) == [("06/05/2024 07:08:09", "u", 'a "b";\nc', '["x","y"]')]
    assert tb.read_records(spark, str(tmp_path / "none"), lib).columns == ["dateaccessed", "url", "t", "tags"]
    (tmp_path / "plain.csv").write_text('"url";"fetched";"status";"contenttype";"contentlength";"lastmodified";"hash"\n"http://a";"";200.0;"";"";"";""\n')
    assert tb.read_frontier(spark, str(tmp_path / "plain.csv")).first()["status"] == 200


def test_runs_and_mirror(spark, tmp_path):
    import datetime

    path = str(tmp_path / "runs")
    for day in range(1, 4):
        tb.log_run(spark, {"run_id": f"r{day}", "started": datetime.datetime(2024, 1, day), "params": {"a": "b"}, "nproc": day}, path)
    assert [r["run_id"] for r in tb.recent_runs(spark.read.parquet(path), 2).collect()] == ["r3", "r2"]
    pages = spark.createDataFrame([(1, "http://h.example/a?x=1", "<p>"), (2, "http://g.example/b.html", "<p>")], PAGES)
    tb.mirror_pages(pages, str(tmp_path / "mirror"))
    assert all(d.startswith(("bucket=", "_", ".")) for d in os.listdir(tmp_path / "mirror"))
    got = {r["page_id"]: r["mirror_path"] for r in spark.read.parquet(str(tmp_path / "mirror")).collect()}
    assert got == {1: "/h.example/aXx=1-index.html", 2: "/g.example/b.html"}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark).endswith(spark.sparkContext.getCheckpointDir().rsplit("/", 1)[-1])


# --- streams -----------------------------------------------------------------------------------


def arrivals(spark, path, *batches):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, PAGES).coalesce(1).write.mode("append").parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    first = [(1, "one/a", "<h1>A</h1>"), (2, "many/b", "<li><b>1</b>"), (3, "one/c", "<h1>A</h1>")]
    second = [(4, "one/a", "<h1>B</h1>"), (5, "one/d", "<h1>A</h1>"), (6, "one/e", "<h1>C</h1>")]
    arrivals(spark, path, first)

    def drain(name, stream):
        sp.save_stream(stream, str(tmp_path / name), str(tmp_path / (name + "-progress"))).awaitTermination()

    def each(query, name):
        query.option("checkpointLocation", str(tmp_path / (name + "-progress"))).trigger(availableNow=True).start().awaitTermination()

    for _ in range(2):
        drain("records", stream_extract(stream_pages(spark, path), LIB, AT))
        drain("dedup", sp.stream_dedup(stream_pages(spark, path)).drop("html"))
        each(sp.stream_first_seen(stream_pages(spark, path), str(tmp_path / "first")), "first")
        each(sp.stream_frontier(stream_pages(spark, path).withColumnRenamed("page_id", "seq"), str(tmp_path / "frontier")), "frontier")
        if _ == 0:
            arrivals(spark, path, second)
    batch = extract(spark.read.parquet(path), LIB, AT)
    assert sorted(rows(spark.read.parquet(str(tmp_path / "records")))) == sorted(rows(batch))
    assert spark.read.parquet(str(tmp_path / "dedup")).count() == 4
    kept = sp.first_seen(spark, str(tmp_path / "first"), T.StructType([*PAGES.fields, T.StructField("hash", T.StringType())]))
    assert sorted(r["page_id"] for r in kept.collect()) == [1, 2, 4, 6]
    latest = {r["url"]: r["seq"] for r in sp.current_frontier(spark, str(tmp_path / "frontier")).collect()}
    assert latest == {"one/a": 4, "many/b": 2, "one/c": 3, "one/d": 5, "one/e": 6}


def test_batch_logs_are_folded(spark, tmp_path):
    """Old batches become one table with the latest row per key; a repeated batch does not see itself."""
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("seq", T.LongType())])
    log = sp.BatchLog(spark, str(tmp_path / "log"), schema, sp._latest("url", ["batch", "seq"]), every=3)
    want = {}
    for number in range(10):
        new = [(f"u{number % 4}", number * 10 + k) for k in range(3)] + [(f"own{number}", number)]
        for _ in range(2 if number in (3, 6) else 1):
            seen = {(r["url"], r["batch"]) for r in log.rows(before=number).collect()}
            assert all(b < number for _, b in seen) and {u for u, _ in seen} == set(want)
            log.append(spark.createDataFrame(new, schema), number)
        want.update(new)
    assert {r["url"]: r["seq"] for r in log.fold(log.rows()).collect()} == want
    live = log.manifest.current()[1]
    assert len(live["batches"]) <= 3 + 1 and live["folded"]
    assert len(os.listdir(tmp_path / "log" / "data")) <= 2 * (3 + 2)  # those of the fold before stay for its readers


def test_streaks_carry_over_parts(spark):
    """A log cut in parts, each begun with the state of the one before, gives what the whole log gives."""
    import random

    from pagetable.operators.runlog import below_rate_streak, streak_state

    draw = random.Random(2)
    log = [(i, int(draw.random() < 0.3), draw.random() < 0.8) for i in range(120)]
    df = spark.createDataFrame(log, "seq long, hit int, reached boolean")
    whole = {r["seq"]: (r["hit_rate"], r["streak"]) for r in below_rate_streak(df, 0.3, 5, reached="reached").collect()}
    state, got = (0, 0, 0), {}
    for a, b in ((0, 1), (1, 40), (40, 41), (41, 120)):
        part = below_rate_streak(df.where(f"seq >= {a} and seq < {b}"), 0.3, 5, reached="reached", start=state)
        got.update({r["seq"]: (r["hit_rate"], r["streak"]) for r in part.collect()})
        state = streak_state(part, state)
    assert got == whole and state[:2] == (sum(h for _, h, _ in log), 120)


def test_elements_meet_by_stretches(spark, one_page):
    from pagetable import parse_dom
    from pagetable.operators.selectors import inside_join, nodes_frame

    html = "<div>" + "<ul><li><b>x</b></li></ul>" * 100 + "</div>" + "<p><i>y</i></p>" * 90
    nodes = nodes_frame(parse_dom(one_page(("u", html), ("v", "<p><i>z</i></p>")))).select("page_id", "idx", "sub_end", "tag")
    rows_of = [tuple(r) for r in nodes.select("page_id", "idx", "sub_end").collect()]
    want = sorted((p, a, b) for p, a, end in rows_of for q, b, _ in rows_of if p == q and a < b <= end)
    assert sorted(tuple(r) for r in inside_join(nodes, nodes).collect()) == want
