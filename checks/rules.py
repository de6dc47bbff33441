"""Checks of conditions, value shapes, gates and whole libraries."""

from pyspark.sql import functions as F

from checks.tables import AD, AT, EDGES_SQL, FLAGSHIP, FOOTER, H1, HREFS, LINKS_SQL, N_LINKS, N_P, TRACK, library, pages, unescaped
from pagetable import active_rules, apply_library, apply_rule, condition_stats, extract, extract_links, preview, rule_stats
from pagetable.plans.extraction import classify, page_rows
from pagetable.sources.tables import csv_view

TEXT = {"ruleTargetAttribute": "text"}
H1_RULE = {"ruleName": "title", "ruleCSSSelector": "h1", **TEXT}
ON_COM = {"ecName": "com", "ecCSSSelector": "footer", "ecTextCondition": r"example\.com"}
ON_NET = {"ecName": "net", "ecCSSSelector": "footer", "ecTextCondition": r"example\.net"}
LONG = {"ecName": "com_long", "ecCSSSelector": "article p:nth-child(8)"}
COM, NET, LONG_SQL = f"{FOOTER} LIKE '%example.com%'", f"{FOOTER} LIKE '%example.net%'", f"({N_P} >= 7)"
L = unescaped


def applied(rules, *columns):
    lib = library(rules)

    def query(spark, sf):
        p = pages(spark, sf).select("page_id", "url", "html")
        out = apply_library(p, lib)
        joined = [
            F.array_join(c, "|", "NULL").alias(c) if dict(out.dtypes)[c].startswith("array<string") else F.col(c)
            for c in columns
        ]
        return out.select("page_id", *joined)

    return query


def with_pre(mode, conditions, expression="", **more):
    return {**H1_RULE, "rulePreconditionType": mode, "rulePreconditionExpression": expression, "rulePreconditions": conditions, **more}


def titled(test):
    return f"SELECT page_id, CASE WHEN {test} THEN {H1} ELSE '' END AS title FROM pages"


def url_rules(spark, sf):
    return active_rules(pages(spark, sf).select("page_id", "url"), FLAGSHIP).select(
        "page_id", F.col("rule_pos").cast("long").alias("rule_pos"), "rule_name"
    )


URL_RULES_SQL = """SELECT page_id, rule_pos, rule_name FROM pages,
  (SELECT unnest([0, 1, 2, 3])::BIGINT AS rule_pos, unnest(['title', 'firstLink', 'trackId', 'getLinks']) AS rule_name)
  WHERE rule_pos > 0 OR url LIKE '%/en/%'"""

OVERRIDE = with_pre(
    "ANY",
    [{**ON_NET, "ecRuleCSSSelector": "nav li:nth-child(2) a"}, {**LONG, "ecRuleCSSSelector": "div.ad"}, ON_COM],
)
OVERRIDE_SQL = f"""SELECT page_id, CASE WHEN {NET} THEN substr({L(HREFS + '[2]')}, 2) WHEN {LONG_SQL} THEN {AD}
  WHEN {COM} THEN {H1} ELSE '' END AS title FROM pages"""

FILTERED = {
    "ruleName": "items", "ruleCSSSelector": "nav li", **TEXT, "ruleReturnsMore": True,
    "ruleMatchPreconditions": [{"ecCSSSelector": "a", "ecTextCondition": "^[a-m]"}],
}
REPLACED = {
    "ruleName": "items", "ruleCSSSelector": "nav li", "ruleTargetAttribute": "href", "ruleReturnsMore": True,
    "ruleMatchPreconditions": [{"ecCSSSelector": "li:nth-child(2) a", "ecRuleCSSSelector": "a"}, {"ecCSSSelector": "a", "ecTextCondition": "^t", "ecRuleCSSSelector": "b"}],
}
CONTENT = {"ruleName": "items", "ruleCSSSelector": "nav a", **TEXT, "ruleReturnsMore": True, "ruleContentCondition": "e$"}


def links_where(test, value="substr(href, 2)", found="items"):
    return f"""WITH {LINKS_SQL} SELECT p.page_id, coalesce(string_agg({value}, '|' ORDER BY pos) FILTER ({test}), '') AS {found}
  FROM pages p LEFT JOIN links l ON l.page_id = p.page_id GROUP BY p.page_id"""


RECORDS = library(
    [
        {"ruleName": "menu", "ruleCSSSelector": "nav li", **TEXT, "ruleReturnsMore": True,
         "rulePostCSSSelector": ["a", "b", "li:nth-child(1) a"], "ruleReturnedValueNames": ["label", "bold", "first", "extra"],
         "ruleRemoveChars": ["ae"]},
        H1_RULE,
    ],
    cols=["label", "bold", "first", "title"],
    required=["label"],
    minimum=0.5,
)


def record_list(spark, sf):
    return csv_view(extract(pages(spark, sf), RECORDS, AT, keep=("page_id", "url"))).select("page_id", "label", "bold", "first", "title")


RECORDS_SQL = f"""WITH {LINKS_SQL} SELECT page_id::VARCHAR AS page_id, trim(translate(substr(href, 2), 'ae', '')) AS label, '' AS bold,
  trim(translate(substr(href, 2), 'ae', '')) AS "first", NULL::VARCHAR AS title
  FROM links WHERE pos = 0 AND trim(translate(substr(href, 2), 'ae', '')) <> ''"""


def record_list_attached(spark, sf):
    out = extract(pages(spark, sf), RECORDS, AT, gate=False, attach_scalars=True, keep=("page_id", "url"))
    return out.groupBy("page_id", "title").agg(F.count("*").alias("n"))


def flagship(spark, sf):
    return csv_view(extract(pages(spark, sf), FLAGSHIP, AT))


FLAGSHIP_SQL = f"""SELECT '01/01/2024 00:00:00' AS dateaccessed, url, {H1} AS title, {L(HREFS + '[1]')} AS "firstLink",
  {TRACK} AS "trackId" FROM pages WHERE url LIKE '%/en/%' AND {H1} <> ''"""


def ungated(spark, sf):
    return csv_view(extract(pages(spark, sf), FLAGSHIP, AT, gate=False))


UNGATED_SQL = f"""SELECT '01/01/2024 00:00:00' AS dateaccessed, url, CASE WHEN url LIKE '%/en/%' THEN {H1} END AS title,
  {L(HREFS + '[1]')} AS "firstLink", {TRACK} AS "trackId" FROM pages"""

SPARSE = library(
    [
        {**with_pre("ANY", [ON_COM]), "ruleName": "a"},
        {**with_pre("ANY", [ON_NET]), "ruleName": "b", "ruleURLActivationCondition": ["/en/"]},
        {**with_pre("ALL", [LONG]), "ruleName": "c"},
    ],
    cols=["a", "b", "c"],
    minimum=0.6,
)


def fill_gate(spark, sf):
    return csv_view(extract(pages(spark, sf), SPARSE, AT))


FILL_SQL = f"""SELECT '01/01/2024 00:00:00' AS dateaccessed, url, a, b, c FROM (
  SELECT url, CASE WHEN {COM} THEN {H1} ELSE '' END AS a,
    CASE WHEN url LIKE '%/en/%' THEN CASE WHEN {NET} THEN {H1} ELSE '' END END AS b,
    CASE WHEN {LONG_SQL} THEN {H1} ELSE '' END AS c FROM pages)
  WHERE round(((a <> '')::INT + (coalesce(b, '') <> '')::INT + (c <> '')::INT)::DOUBLE / (2 + (b IS NOT NULL)::INT), 2) >= 0.6"""


def classified(spark, sf):
    """Pages whose menu rule is active give a record list, the others a record."""
    menu = RECORDS.rules[0]
    lib = library([], cols=["label", "title"])
    lib = lib.with_rule(
        {"ruleName": "menu", "ruleURLActivationCondition": ["/fr/"], "ruleCSSSelector": menu.css, **TEXT, "ruleReturnsMore": True,
         "rulePostCSSSelector": ["a"], "ruleReturnedValueNames": ["label"]}
    ).with_rule(H1_RULE)
    return classify(pages(spark, sf).select("page_id", "url", "html"), lib).select("page_id", "is_record_list")


def record_rows(spark, sf):
    rows = page_rows(pages(spark, sf).select("page_id", "url", "html"), RECORDS)
    return rows.select("page_id", F.size("_rows").cast("long").alias("n"))


def previewed(spark, sf):
    out = preview(pages(spark, sf).select("page_id", "url", "html"), FLAGSHIP)
    return out.select("page_id", "rule", "key", "kind", F.col("pos").cast("long").alias("pos"), "value")


PREVIEW_SQL = f"""WITH {LINKS_SQL}
SELECT page_id, 'title' AS rule, 'title' AS key, 'scalar' AS kind, 0 AS pos, {H1} AS value FROM pages WHERE url LIKE '%/en/%'
UNION ALL SELECT page_id, 'firstLink', 'firstLink', 'scalar', 0, href FROM links WHERE pos = 0
UNION ALL SELECT page_id, 'trackId', 'trackId', 'scalar', 0, {TRACK} FROM pages
UNION ALL SELECT page_id, 'getLinks', 'getLinks', 'list', pos, href FROM links"""


def one_rule(spark, sf):
    return apply_rule(pages(spark, sf).select("page_id", "url", "html"), FLAGSHIP, "title").select("page_id", "title")


def link_edges(spark, sf):
    out = extract_links(pages(spark, sf), FLAGSHIP)
    return out.select("src_url", "dst_url", F.col("pos").cast("long").alias("pos"))


FILTERED_LINKS = library([{**{"ruleName": "getLinks", "ruleCSSSelector": "a[href]", "ruleTargetAttribute": "href", "ruleReturnsMore": True}, "ruleContentCondition": r"example\.(com|org)/t"}])


def link_edges_filtered(spark, sf):
    out = extract_links(pages(spark, sf), FILTERED_LINKS)
    return out.select("src_url", "dst_url", F.col("pos").cast("long").alias("pos"))


OVERWRITE = [
    {"ruleName": "v", "ruleCSSSelector": "h1", **TEXT},
    {"ruleName": "v", "ruleURLActivationCondition": ["/fr/"], "ruleCSSSelector": "div.ad", **TEXT},
    {"ruleName": "v", "ruleURLActivationCondition": ["/de/"], "ruleCSSSelector": "nav a", **TEXT, "ruleReturnedMatchPos": 99},
]

COUNTED = library(
    [
        with_pre("ANY", [ON_COM, ON_NET, LONG]),
        {**with_pre("ALL", [ON_COM, LONG]), "ruleName": "both", "ruleURLActivationCondition": ["/en/"]},
        {**with_pre("EVAL", [ON_COM, LONG], "com and not com_long"), "ruleName": "eval", "ruleCSSSelector": "nav a", "ruleReturnsMore": True},
        {"ruleName": "links", "ruleCSSSelector": "nav a", "ruleTargetAttribute": "href", "ruleReturnsMore": True},
    ]
)


def rule_counts(spark, sf):
    out = rule_stats(pages(spark, sf), COUNTED)
    return out.select(F.col("rule_pos").cast("long").alias("rule_pos"), "rule_name", "url_matched", "applied", "matches", "precondition_failed")


FLAGS = f"(SELECT url, {COM} AS com, {NET} AS net, {LONG_SQL} AS lng, {N_LINKS} AS links FROM pages)"
RULE_COUNTS_SQL = f"""WITH f AS {FLAGS}
SELECT 0 AS rule_pos, 'title' AS rule_name, count(*) AS url_matched, count_if(com OR net OR lng)::BIGINT AS applied,
  count_if(com OR net OR lng)::BIGINT AS matches, count_if(NOT (com OR net OR lng))::BIGINT AS precondition_failed FROM f
UNION ALL SELECT 1, 'both', count(*), count_if(com AND lng)::BIGINT, count_if(com AND lng)::BIGINT,
  count_if(NOT (com AND lng))::BIGINT FROM f WHERE url LIKE '%/en/%'
UNION ALL SELECT 2, 'eval', count(*), count_if(com AND NOT lng)::BIGINT,
  coalesce(sum(links) FILTER (com AND NOT lng), 0)::BIGINT, count_if(NOT (com AND NOT lng))::BIGINT FROM f
UNION ALL SELECT 3, 'links', count(*), count(*), 0, 0 FROM f"""


def condition_counts(spark, sf):
    return condition_stats(pages(spark, sf), COUNTED).select(
        "rule_name", F.col("cond_pos").cast("long").alias("cond_pos"), "cond_name", "applied", "exists_count", "true_count", "false_count"
    )


def _cond(rule, pos, name, reached, there, holds, where="true"):
    return f"""SELECT '{rule}' AS rule_name, {pos} AS cond_pos, '{name}' AS cond_name, count_if({reached})::BIGINT AS applied,
  count_if({reached} AND {there})::BIGINT AS exists_count, count_if({reached} AND {holds})::BIGINT AS true_count,
  count_if({reached} AND NOT {holds})::BIGINT AS false_count FROM f WHERE {where}"""


CONDITION_SQL = f"WITH f AS (SELECT *, html LIKE '%<footer>%' AS foot FROM (SELECT url, html, {COM} AS com, {NET} AS net, {LONG_SQL} AS lng FROM pages)) " + " UNION ALL ".join(
    [
        _cond("title", 0, "com", "true", "foot", "com"),
        _cond("title", 1, "net", "NOT com", "foot", "net"),
        _cond("title", 2, "com_long", "(NOT com AND NOT net)", "lng", "lng"),
        _cond("both", 0, "com", "true", "foot", "com", "url LIKE '%/en/%'"),
        _cond("both", 1, "com_long", "com", "lng", "lng", "url LIKE '%/en/%'"),
        _cond("eval", 0, "com", "true", "foot", "com"),
        _cond("eval", 1, "com_long", "true", "lng", "lng"),
    ]
)

QUERIES = {
    "rules_active": (url_rules, URL_RULES_SQL),
    "condition_holds": (applied([with_pre("ANY", [ON_COM])], "title"), titled(COM)),
    "precondition_any": (applied([with_pre("Any", [ON_NET, LONG])], "title"), titled(f"{NET} OR {LONG_SQL}")),
    "precondition_any_override": (applied([OVERRIDE], "title"), OVERRIDE_SQL),
    "precondition_all": (applied([with_pre("ALL", [ON_COM, LONG])], "title"), titled(f"{COM} AND {LONG_SQL}")),
    "precondition_eval": (
        applied([with_pre("EVAL", [ON_COM, ON_NET, LONG], "(COM or net) and not com_long")], "title"),
        titled(f"({COM} OR {NET}) AND NOT {LONG_SQL}"),
    ),
    "precondition_none": (applied([H1_RULE], "title"), titled("true")),
    "precondition_unknown": (applied([with_pre("SOME", [ON_COM])], "title"), titled("false")),
    "match_filter": (applied([FILTERED], "items"), links_where("regexp_matches(substr(href, 2), '^[a-m]')")),
    "match_replace": (applied([REPLACED], "items"), links_where("pos = 1", "href")),
    "content_filter": (applied([CONTENT], "items"), links_where("href LIKE '%e' AND length(href) > 1")),
    "value_text_last": (
        applied([{"ruleName": "v", "ruleCSSSelector": "nav a", **TEXT, "ruleRemoveChars": ["th", "a"]}], "v"),
        f"SELECT page_id, replace(replace(substr({L(HREFS + '[-1]')}, 2), 'th', ''), 'a', '') AS v FROM pages",
    ),
    "value_text_position": (
        applied([{"ruleName": "v", "ruleCSSSelector": "nav a", **TEXT, "ruleReturnedMatchPos": 5}, {"ruleName": "w", "ruleCSSSelector": "table", **TEXT}], "v", "w"),
        f"SELECT page_id, CASE WHEN {N_LINKS} > 5 THEN substr({L(HREFS + '[6]')}, 2) END AS v, '' AS w FROM pages",
    ),
    "values_text": (
        applied([{"ruleName": "items", "ruleCSSSelector": "nav a", **TEXT, "ruleReturnsMore": True}], "items"),
        links_where("href IS NOT NULL"),
    ),
    "values_positional": (
        applied([{"ruleName": "x", "ruleCSSSelector": "nav a", **TEXT, "ruleReturnsMore": True, "ruleReturnedValueNames": ["one", "two", "six"]}], "one", "two", "six"),
        f"SELECT page_id, substr({L(HREFS + '[1]')}, 2) AS one, substr({L(HREFS + '[2]')}, 2) AS two, substr({L(HREFS + '[3]')}, 2) AS six FROM pages",
    ),
    "value_attribute": (
        applied([{"ruleName": "v", "ruleCSSSelector": "nav a", "ruleTargetAttribute": "href", "ruleReturnedMatchPos": 1}], "v"),
        f"SELECT page_id, {L(HREFS + '[2]')} AS v FROM pages",
    ),
    "values_attribute": (
        applied([{"ruleName": "items", "ruleCSSSelector": "nav a", "ruleTargetAttribute": "href"}], "items"),
        links_where("href IS NOT NULL", "href"),
    ),
    "value_script": (
        applied([{"ruleName": "v", "ruleTarget": "js", "ruleContentCondition": r"t(rack\(\d+)\)"}], "v"),
        r"SELECT page_id, regexp_extract(html, 't(rack\(\d+)\)', 1) AS v FROM pages",
    ),
    "later_rule_wins": (
        applied(OVERWRITE, "v"),
        f"SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN {AD} ELSE {H1} END AS v FROM pages",
    ),
    "one_rule": (one_rule, f"SELECT page_id, {H1} AS title FROM pages WHERE url LIKE '%/en/%'"),
    "record_list": (record_list, RECORDS_SQL),
    "record_list_attached": (
        record_list_attached,
        f"SELECT page_id, {H1} AS title, {N_LINKS} AS n FROM pages WHERE {N_LINKS} > 0",
    ),
    "record_rows": (record_rows, f"SELECT page_id, greatest({N_LINKS}, 1) AS n FROM pages"),
    "page_classes": (
        classified,
        f"SELECT page_id, url LIKE '%/fr/%' AND {N_LINKS} > 0 AS is_record_list FROM pages",
    ),
    "extract_library": (flagship, FLAGSHIP_SQL),
    "extract_ungated": (ungated, UNGATED_SQL),
    "fill_gate": (fill_gate, FILL_SQL),
    "preview": (previewed, PREVIEW_SQL),
    "link_edges": (link_edges, f"WITH {EDGES_SQL} SELECT src_url, dst_url, pos FROM edges"),
    "link_edges_filtered": (
        link_edges_filtered,
        f"WITH {EDGES_SQL} SELECT src_url, dst_url, pos FROM edges WHERE regexp_matches(dst_url, 'example\\.(com|org)/t')",
    ),
    "rule_stats": (rule_counts, RULE_COUNTS_SQL),
    "condition_stats": (condition_counts, CONDITION_SQL),
}
