"""The level-wise walk against a page-by-page walk in plain Python."""

import hashlib
import random
import re
import sys
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from checks.tables import linked_pages
from pagetable.functions.http import ALLOWED_CONTENT
from pagetable import Library, crawl, resume

AT = "2024-01-01 00:00:00"
LIB = Library.from_dict(
    {
        "csvLineFormat": ["t"],
        "requiredFilledFields": ["t"],
        "library": [
            {"ruleName": "t", "ruleCSSSelector": "h1", "ruleTargetAttribute": "text"},
            {"ruleName": "getLinks", "ruleCSSSelector": "a[href]", "ruleTargetAttribute": "href", "ruleReturnsMore": True, "ruleContentCondition": "h.example"},
        ],
    }
)


def site(n, seed):
    """Captures with dead links, copies, other types, errors, empty bodies and pages without a title."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        links = [rnd.randrange(n + 3) for _ in range(rnd.randrange(5))]
        hrefs = "".join(f"<a href='{rnd.choice(['/p%d', 'p%d#x', 'http://h.example/p%d', '#p%d', 'http://other.example/p%d'])}'>x</a>" % j for j in links)
        title = "" if rnd.random() < 0.3 else f"<h1>T{i if rnd.random() < 0.7 else 0}</h1>"
        body = title + (hrefs if i else "".join(f"<a href=/p{j}>x</a>" for j in range(1, 6)))
        status = 404 if i and rnd.random() < 0.1 else 200
        kind = rnd.choice(["text/html"] * 8 + ["image/png", "application/pdf"]) if i else "text/html"
        if i and rnd.random() < 0.05:
            body = ""
        out.append((i, f"http://h.example/p{i}", status, {"Content-Type": kind}, body))
    return out


def walk(pages, seeds, max_pages=-1, max_size=-1, min_rate=-1.0, samples=50):
    by_url = {p[1]: p for p in pages}
    queue, state, hashes = [], {}, set()

    def add(u):
        if (max_size < 0 or len(queue) < max_size) and u not in state:
            queue.append(u)
            state[u] = -1

    for s in seeds:
        add(s)
    processed = extracted = fetched = below = i = 0
    records = []
    while i < len(queue):
        u = queue[i]
        i += 1
        rate = extracted / fetched if fetched else 0.0
        fetched += 1
        if u.split(":")[0] not in ("http", "https"):
            state[u] = -11
            continue
        if u not in by_url:
            state[u] = -4
            continue
        _, _, status, headers, body = by_url[u]
        kind = headers["Content-Type"]
        state[u] = status
        if status != 200:
            continue
        if not re.search(ALLOWED_CONTENT, kind):
            state[u] = -700
            continue
        if not body:
            state[u] = -999
            continue
        h = hashlib.sha256(body.encode()).hexdigest()
        if h in hashes:
            continue
        hashes.add(h)
        if "html" not in kind:
            continue
        for href in re.findall(r"<a href='?([^'>]*)", body):
            if not href.startswith("#"):
                full = urljoin(u, href).split("#")[0]
                if "h.example" in full:
                    add(full)
        m = re.search("<h1>(.*?)</h1>", body)
        if m:
            records.append((u, m[1]))
        processed += 1
        extracted = len(records)
        if 0 < max_pages <= processed:
            break
        if rate < min_rate:
            below += 1
            if below >= samples:
                break
        else:
            below = 0
    return [(u, state[u]) for u in queue], sorted(records)


SCHEMA = "seq long, url string, status int, headers map<string,string>, html string"


def outcome(result):
    rows = result.frontier.orderBy("seq").select("seq", "url", "status").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    return [(r["url"], r["status"]) for r in rows], sorted((r["url"], r["t"]) for r in result.records.collect())


@pytest.mark.parametrize(
    "seed, options",
    [
        (1, {}),
        (2, {"max_pages": 9}),
        (3, {"max_queue_size": 12}),
        (4, {"min_hit_rate": 0.55, "hit_samples": 3}),
        (5, {"max_pages": 14, "max_queue_size": 20}),
    ],
)
def test_breadth_first_equals_page_by_page(spark, seed, options):
    pages = site(40, seed)
    starts = ["http://h.example/p0", "ftp://h.example/p1", "http://h.example/p0", "http://h.example/p7"]
    names = {"max_queue_size": "max_size", "min_hit_rate": "min_rate", "hit_samples": "samples"}
    want = walk(pages, starts, **{names.get(k, k): v for k, v in options.items()})
    seeds = spark.createDataFrame(list(enumerate(starts)), "seq long, url string")
    got = crawl(spark.createDataFrame(pages, SCHEMA), LIB, seeds, accessed_at=AT, **options)
    assert outcome(got) == want


def test_resume_equals_one_run(spark):
    pages = site(30, 6)
    start = ["http://h.example/p0"]
    corpus, seeds = spark.createDataFrame(pages, SCHEMA), spark.createDataFrame([(0, start[0])], "seq long, url string")
    part = crawl(corpus, LIB, seeds, max_pages=6, accessed_at=AT)
    whole = resume(corpus, LIB, part.frontier, part.records, accessed_at=AT)
    rows, records = walk(pages, start)
    assert sorted((r["url"], r["status"]) for r in whole.frontier.collect()) == sorted(rows)
    assert sorted((r["url"], r["t"]) for r in whole.records.collect()) == records


def test_depth_first_numbers_the_forest_in_preorder(spark):
    # p0 -> p1, p2; p1 -> p3; p2 -> p4, p5: the last link is taken first
    links = {0: [1, 2], 1: [3], 2: [4, 5], 3: [], 4: [], 5: []}
    pages = [(i, f"http://h.example/p{i}", f"<h1>T{i}</h1>" + "".join(f"<a href=/p{j}>x</a>" for j in js)) for i, js in links.items()]
    corpus = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.example/p0")], "seq long, url string")
    rows, _ = outcome(crawl(corpus, LIB, seeds, order="dfs", accessed_at=AT))
    assert [u[-1] for u, _ in rows] == ["0", "2", "5", "4", "1", "3"]
    for limit in ({"max_queue_size": 3}, {"max_pages": 3}, {"min_hit_rate": 0.5}, {"max_levels": 2}, {"max_queue_bytes": "1K"}):
        with pytest.raises(ValueError):
            crawl(corpus, LIB, seeds, order="dfs", **limit)


def test_seeds_meet_the_corpus_by_canonical_form(spark):
    pages = [(0, "http://h.example/p0#top", "<h1>T0</h1><a href=/p1#x>x</a>"), (1, "http://h.example/p1", "<h1>T1</h1>")]
    corpus = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.example/p0#top")], "seq long, url string")
    rows, records = outcome(crawl(corpus, LIB, seeds, accessed_at=AT))
    assert rows == [("http://h.example/p0#top", 200), ("http://h.example/p1", 200)]
    assert records == [("http://h.example/p0#top", "T0"), ("http://h.example/p1", "T1")]


def test_saved_queue_resumes_in_order(spark, tmp_path):
    """Through files: after one page the first link, not the first name, is next; a file without places keeps its lines."""
    from pagetable.sources.tables import read_frontier, write_frontier

    links = {0: ["z", "b", "m"], "z": [], "b": [], "m": []}
    pages = [(i, f"http://h.example/p{k}", f"<h1>T{k}</h1>" + "".join(f"<a href=/p{j}>x</a>" for j in js)) for i, (k, js) in enumerate(links.items())]
    corpus = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.example/p0")], "seq long, url string")
    part = crawl(corpus, LIB, seeds, max_pages=1, accessed_at=AT)
    write_frontier(part.frontier, str(tmp_path / "f"))
    saved = read_frontier(spark, str(tmp_path / "f"))
    assert [r["url"][-1] for r in saved.where("status = -1").orderBy("seq").collect()] == ["z", "b", "m"]
    more = resume(corpus, LIB, saved, part.records, max_pages=1, accessed_at=AT)
    assert [(r["url"][-1], r["status"], r["depth"]) for r in more.frontier.orderBy("seq").collect()] == [
        ("0", 200, 0), ("z", 200, 1), ("b", -1, 1), ("m", -1, 1),
    ]
    bare = part.frontier.orderBy("seq").select("url", "fetched", "status", "contenttype", "contentlength", "lastmodified", "hash").coalesce(1)
    write_frontier(bare, str(tmp_path / "g"))
    assert [r["url"][-1] for r in read_frontier(spark, str(tmp_path / "g")).orderBy("seq").collect()] == ["0", "z", "b", "m"]


def test_run_folders_can_be_removed(spark):
    import os

    from pagetable.plans.checkpoints import drop_folder

    corpus = spark.createDataFrame([(0, "http://h.example/p0", "<h1>x</h1>")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.example/p0")], "seq long, url string")
    got = crawl(corpus, LIB, seeds, max_pages=5, accessed_at=AT)
    got.frontier.collect()
    folder = got.folder.removeprefix("file:")
    assert os.listdir(folder)
    drop_folder(spark, got.folder)
    assert not os.path.exists(folder)


def test_queue_bytes_and_levels(spark):
    links = {0: [1, 2, 3, 4], 1: [5], 2: [], 3: [], 4: [], 5: []}
    pages = [(i, f"http://h.example/p{i}", f"<h1>T{i}</h1>" + "".join(f"<a href=/p{j}>x</a>" for j in js)) for i, js in links.items()]
    corpus = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.example/p0")], "seq long, url string")
    size = len("http://h.example/p0")
    rows, _ = outcome(crawl(corpus, LIB, seeds, max_queue_bytes=str(3 * size - 1), accessed_at=AT))
    assert [u[-1] for u, _ in rows] == ["0", "1", "2"]
    rows, _ = outcome(crawl(corpus, LIB, seeds, max_levels=1, accessed_at=AT))
    assert [(u[-1], s) for u, s in rows] == [("0", 200), ("1", -1), ("2", -1), ("3", -1), ("4", -1)]


def test_library_without_links_or_columns(spark):
    corpus = spark.createDataFrame([(0, "http://h.example/p0", "<h1>x</h1>")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.example/p0")], "seq long, url string")
    library = Library.from_dict({"library": [{"ruleName": "t", "ruleCSSSelector": "h1", "ruleTargetAttribute": "text"}]})
    got = crawl(corpus, library, seeds, accessed_at=AT)
    assert got.frontier.count() == 1 and got.records.count() == 0


def test_preorder_of_random_forests(spark, tmp_path):
    """Against a recursive walk: many roots, deep chains and wide nodes, roots in two groups."""
    import random

    from pagetable.plans.crawl import preorder

    draw = random.Random(3)
    rows, kids = [], {}
    for i in range(400):
        seq = 3 * i + 1  # places need not be dense
        deep = draw.random() < 0.5 and i > 10
        src = -draw.randint(1, 2) if i < 5 else (rows[-1][0] if deep else draw.choice(rows)[0])
        rows.append((seq, src, i))
        kids.setdefault(src, []).append((i, seq))
    want = []

    def walk(seq):
        want.append(seq)
        for _, child in sorted(kids.get(seq, []), reverse=True):
            walk(child)

    for group in (-1, -2):
        for _, root in sorted(kids.get(group, []), reverse=True):
            walk(root)
    got = preorder(spark.createDataFrame(rows, "seq long, src long, pos long"), str(tmp_path / "forest")).collect()
    assert [r["seq"] for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(len(rows)))


def test_a_level_reads_the_corpus_once(spark, monkeypatch):
    """Outcomes of a level come from what was looked up for it, which is stored."""
    module, inputs = sys.modules["pagetable.plans.crawl"], {}
    store = module.through_table

    def noted(df, path):
        inputs[path.rsplit("/", 1)[-1]] = [f for f in df.inputFiles() if "/corpus/" in f]
        return store(df, path)

    monkeypatch.setattr(module, "through_table", noted)
    pages = spark.createDataFrame([(i, f"http://h.example/p{i}", f"<h1>T{i}</h1><a href=/p{i + 1}>x</a>") for i in range(2)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.example/p0")], "seq long, url string")
    assert crawl(pages, LIB, seeds, accessed_at=AT).frontier.count() == 3
    assert inputs["met-0"] and inputs["met-1"]
    assert not inputs["done-0"] and not inputs["done-1"]


def test_linked_pages_move_sources_once(spark, tmp_path):
    """Only one join holds the pages' sources; repeated and NULL ids give the rows that two joins of the pages give."""
    rows = [(i, f"http://h.example/p{i}#a", f"<p>{i}</p>") for i in [0, 1, 2, 3, 3, 4, None]] + [(5, None, "<p>5</p>"), (6, "http://h.example/p6", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = linked_pages(spark, str(tmp_path))

    def joins(plan):
        below = sum(joins(plan.children().apply(i)) for i in range(plan.children().size()))
        return below + (plan.nodeName() == "Join" and "html#" in plan.output().toString())

    assert joins(got._jdf.queryExecution().optimizedPlan()) == 1
    urls = {}
    for i, url, _ in rows:
        urls.setdefault(i, []).append(url and url.split("#")[0])
    want = [
        (i, url and url.split("#")[0], html and a and b and f'{html}<div id="next"><a href="{a}">x</a><a href="{b}">y</a></div>')
        for i, url, html in rows if i is not None
        for a in urls.get((7 * i + 1) % 9, []) for b in urls.get((3 * i + 2) % 9, [])
    ]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
