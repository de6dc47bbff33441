"""Checks of parsing, selectors and element operators."""

from pyspark.sql import functions as F

from checks.tables import AD, FOOTER, H1, HREFS, LINKS_SQL, N_LINKS, N_P, TRACK, flat, pages, parsed, unescaped
from pagetable.operators.dom import attr_of, parse_dom, script_capture, text_of, visible_text
from pagetable.operators.selectors import containing, find_first, inside_join, match_count, matches_frame, nodes_frame, select

TAGS = ["a", "article", "b", "body", "br", "div", "footer", "h1", "head", "html", "li", "meta", "nav", "p", "script", "style", "title", "ul"]


def tag_counts(spark, sf):
    tags = parsed(spark, sf).select(F.explode(F.transform("dom", lambda n: n["tag"])).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


TAG_SQL = """SELECT tag, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-z0-9]+)', 1)) AS tag FROM pages)
  GROUP BY tag"""


def counting(css):
    def query(spark, sf):
        return parsed(spark, sf).select("page_id", match_count(css).cast("long").alias("n"))

    return query


def texts(css):
    def query(spark, sf):
        rows = matches_frame(parsed(spark, sf), css)
        return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "text")

    return query


def per_link(keep: str) -> str:
    """Link texts (equal to the href without its first character) that satisfy a test on `pos` (from 0)."""
    return f"""WITH {LINKS_SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos,
  substr(href, 2) AS text FROM links l WHERE {keep}"""


LAST = "pos = (SELECT max(pos) FROM links m WHERE m.page_id = l.page_id)"


def heading(spark, sf):
    return parsed(spark, sf).select("page_id", text_of(F.get(select("h1"), F.lit(0))).alias("title"))


def hrefs(spark, sf):
    found = F.transform(select("a[href]"), lambda n: attr_of(n, "HREF"))
    rows = parsed(spark, sf).select("page_id", F.posexplode_outer(found).alias("pos", "href")).where("href is not null")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def first_inside(spark, sf):
    """First match below an element; ancestors above it do not count, the element itself does."""
    nav = F.get(select("nav"), F.lit(0))
    return parsed(spark, sf).select(
        "page_id",
        text_of(find_first(nav, "nav li:nth-child(2) a")).alias("second"),
        find_first(nav, "body a").isNull().alias("outside"),
        find_first(nav, "nav").isNotNull().alias("itself"),
    )


def script_value(spark, sf):
    return parsed(spark, sf).select(
        "page_id", script_capture(r"track\((\d+)\)").alias("track"), script_capture("nothing(x)").alias("none")
    )


def total_matches(spark, sf):
    return parsed(spark, sf).agg(
        F.sum(match_count("a[href]")).cast("long").alias("links"), F.sum(match_count("article p")).cast("long").alias("paragraphs")
    )


def text_shown(spark, sf):
    return parsed(spark, sf).select("page_id", visible_text().alias("text"))


VISIBLE_SQL = rf"""SELECT page_id, array_to_string([t FOR t IN [{flat(unescaped('x'))} FOR x IN string_split(regexp_replace(
    regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', ''), '(?s)<!--.*?-->', chr(1), 'g'),
    '<[^>]*>', chr(1), 'g'), chr(1))] IF t <> ''], ' ') AS text FROM pages"""


def _rewritten(spark, sf, html):
    source = pages(spark, sf).select("page_id", html.alias("html"))
    return parse_dom(source)


def deep_nesting(spark, sf):
    """Every page inside 600 more elements, with a paragraph behind them."""
    n = 600
    whole = F.concat(F.lit('<section id="outer">' + "<div>" * n), "html", F.lit("</div>" * n + "<p>behind</p></section>"))
    d = _rewritten(spark, sf, whole)
    return d.select(
        "page_id",
        text_of(F.get(select("#outer div article h1"), F.lit(0))).alias("title"),
        match_count("#outer > p").cast("long").alias("behind"),
        match_count("#outer p").cast("long").alias("inside"),
    )


def loose_tail(spark, sf):
    """Every page with an unclosed comment of hundreds of < behind it."""
    d = _rewritten(spark, sf, F.concat("html", F.lit("<!-- " + "a<b " * 300)))
    return d.select("page_id", visible_text().alias("text"), script_capture(r"track\((\d+)\)").alias("track"))


def by_id(spark, sf):
    """The link list, once marked with an id."""
    d = _rewritten(spark, sf, F.expr("replace(html, '<ul>', '<ul id=\"list\">')"))
    return d.select("page_id", match_count("#list > li > a").cast("long").alias("n"))


def holder(spark, sf):
    item = containing("li", "a")
    none = containing("nav", "h1")
    return parsed(spark, sf).select("page_id", text_of(item).alias("item"), item["nth"].cast("long").alias("nth"), none.isNull().alias("none"))


def nested_elements(spark, sf):
    """Links inside list items by an interval join of elements on the page."""
    nodes = nodes_frame(parsed(spark, sf)).select("page_id", "idx", "sub_end", "tag")
    met = inside_join(nodes.where("tag = 'li'"), nodes.where("tag = 'a'"))
    return met.groupBy("page_id").agg(F.count("*").alias("n"))


def inside_all(spark, sf):
    """Elements below the body, which is as long as the page."""
    nodes = nodes_frame(parsed(spark, sf)).select("page_id", "idx", "sub_end", "tag")
    met = inside_join(nodes.where("tag = 'body'"), nodes)
    return met.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("inner_idx").alias("different"))


QUERIES = {
    "dom_tag_counts": (tag_counts, TAG_SQL),
    "select_type": (texts("h1"), f"SELECT page_id, 0 AS pos, {H1} AS text FROM pages"),
    "select_universal": (
        counting("article > *"),
        f"SELECT page_id, {N_P} + 1 AS n FROM pages",
    ),
    "select_class": (texts("div.ad"), f"SELECT page_id, 0 AS pos, {AD} AS text FROM pages"),
    "select_attribute": (counting("[href]"), f"SELECT page_id, {N_LINKS} AS n FROM pages"),
    "select_descendant": (texts("nav a"), per_link("true")),
    "select_child": (texts("nav > ul > li > a"), per_link("true")),
    "select_adjacent": (texts("div.ad + article h1"), f"SELECT page_id, 0 AS pos, {H1} AS text FROM pages"),
    "select_nth": (texts("li:nth-child(2) a"), per_link("pos = 1")),
    "select_nth_formula": (texts("li:nth-child(2n+1) a"), per_link("pos % 2 = 0")),
    "select_not": (texts("li:not(:nth-child(1)) a"), per_link("pos > 0")),
    "select_list": (
        counting("h1 , nav a, footer, h1"),
        f"SELECT page_id, {N_LINKS} + 2 AS n FROM pages",
    ),
    "select_attribute_value": (
        counting('a[href^="/a"], a[href$="e"], a[href*="in"], a[href="/the"]'),
        f"""WITH {LINKS_SQL} SELECT p.page_id, count(l.href) AS n FROM pages p LEFT JOIN links l ON l.page_id = p.page_id
  AND (l.href LIKE '/a%' OR l.href LIKE '%e' OR l.href LIKE '%in%' OR l.href = '/the') GROUP BY p.page_id""",
    ),
    "select_class_word": (counting("div[class~=ad], html[lang|=en]"), "SELECT page_id, 1 + (html LIKE '%<html lang=\"en\">%')::INT AS n FROM pages"),
    "select_sibling": (counting("li ~ li, style ~ script"), f"SELECT page_id, greatest({N_LINKS} - 1, 0) + 1 AS n FROM pages"),
    "select_first_last": (texts("li:first-child a, li:last-child a"), per_link(f"pos = 0 OR {LAST}")),
    "element_text": (heading, f"SELECT page_id, {H1} AS title FROM pages"),
    "element_attribute": (hrefs, f"WITH {LINKS_SQL} SELECT page_id, pos, href FROM links"),
    "element_find_first": (
        first_inside,
        f"SELECT page_id, substr({unescaped(HREFS + '[2]')}, 2) AS second, true AS outside, true AS itself FROM pages",
    ),
    "script_value": (script_value, f"SELECT page_id, {TRACK} AS track, NULL::VARCHAR AS none FROM pages"),
    "match_totals": (
        total_matches,
        f"SELECT sum({N_LINKS})::BIGINT AS links, sum({N_P})::BIGINT AS paragraphs FROM pages",
    ),
    "visible_text": (text_shown, VISIBLE_SQL),
    "dom_deep_nesting": (
        deep_nesting,
        f"SELECT page_id, {H1} AS title, 1 AS behind, {N_P} + 1 AS inside FROM pages",
    ),
    "dom_loose_tail": (loose_tail, f"SELECT page_id, text, {TRACK} AS track FROM ({VISIBLE_SQL}) JOIN pages USING (page_id)"),
    "select_id": (by_id, f"SELECT page_id, {N_LINKS} AS n FROM pages"),
    "element_containing": (
        holder,
        f"SELECT page_id, substr({unescaped(HREFS + '[1]')}, 2) AS item, 1 AS nth, true AS none FROM pages",
    ),
    "element_intervals": (nested_elements, f"SELECT page_id, {N_LINKS} AS n FROM pages WHERE {N_LINKS} > 0"),
    "element_intervals_long": (
        inside_all,
        """SELECT page_id, n, n AS different FROM (SELECT page_id, len(regexp_extract_all(regexp_replace(
  regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)^.*<body[^>]*>', ''), '<([a-z0-9]+)', 1)) AS n FROM pages) WHERE n > 0""",
    ),
    "footer_text": (texts("footer"), f"SELECT page_id, 0 AS pos, {FOOTER} AS text FROM pages WHERE html LIKE '%</footer>%'"),
}
