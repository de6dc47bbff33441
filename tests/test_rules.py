"""Whole libraries on small hand-written sites, one per feature of the rule language."""

import pytest
from pyspark.sql import functions as F

from pagetable import Library, apply_library, apply_rule, condition_stats, extract, extract_links, preview, rule_stats
from pagetable.plans.extraction import record_list_conflicts
from pagetable.sources.tables import csv_view

AT = "2024-05-06 07:08:09"
TEXT = {"ruleTargetAttribute": "text"}


def lib(rules, cols=(), required=(), minimum=None):
    return Library.from_dict(
        {"csvLineFormat": list(cols), "requiredFilledFields": list(required), "allowedMinimumFilled": minimum, "library": rules}
    )


def records(pages, library, **options):
    out = csv_view(extract(pages, library, AT, **options))
    return sorted((tuple(r) for r in out.drop("dateaccessed").collect()), key=str)


STATIONS = lib(
    [
        {"ruleName": "level", "ruleURLActivationCondition": [r"/station/\d+$", "^buoy:"], "ruleCSSSelector": "dl dd", **TEXT, "ruleRemoveChars": ["~", " m"]},
        {"ruleName": "kind", "ruleURLActivationCondition": ["station|buoy"], "ruleCSSSelector": "main[data-kind]", "ruleTargetAttribute": "data-kind", "ruleReturnedMatchPos": 0},
        {"ruleName": "keeper", "ruleURLActivationCondition": ["/staff"], "ruleCSSSelector": "em", **TEXT},
    ],
    ["kind", "keeper", "level"],
)


def test_scalars_of_a_page(one_page):
    """Texts and attributes, patterns that leave rules out, removed characters; the last match counts."""
    html = "<main data-kind='tide gauge'><dl><dt>low<dd>1.0 m<dt> high <dd>\n ~3.25  m</dl></main>"
    pages = one_page(("//sea/station/7", html), ("//sea/station/7/map", html), ("buoy:9", "<p>gone</p>"), ("//sea/news", html))
    out = extract(pages, STATIONS, AT)
    assert out.columns == ["dateaccessed", "url", "kind", "keeper", "level"]
    assert records(pages, STATIONS) == [
        ("//sea/station/7", "tide gauge", None, "3.25"),
        ("//sea/station/7/map", "tide gauge", None, None),
        ("buoy:9", "", None, ""),  # nothing found, but present: kept without constraints
    ]
    assert csv_view(out).first()["dateaccessed"] == "06/05/2024 07:08:09"


CONDITIONS = [
    {"ecName": "c1", "ecCSSSelector": "#lead"},
    {"ecName": "c10", "ecCSSSelector": "#kinds", "ecTextCondition": "(?i)alpine"},
    {"ecName": "c2", "ecCSSSelector": "#kinds", "ecTextCondition": "herbs?$"},
]


@pytest.mark.parametrize(
    "mode, expr, kept",
    [
        ("ANY", "", {"h", "r", "hre"}),
        ("all", "", {"hre"}),
        ("Eval", "c1 and not c10", {"h"}),
        ("EVAL", "(C10 OR c2) AND (not c1)", {"r"}),
        ("EVAL", "c1 and (c10 and c2)", {"hre"}),
        ("EVAL", "c1 and unknown", set()),
        ("EVAL", "c1 and", set()),
        ("EVAL", "c1 c2", set()),
        ("EVAL", "((c1)", set()),
        ("EVAL", "__import__('os')", set()),
        ("other", "", set()),
    ],
)
def test_precondition_modes(one_page, mode, expr, kept):
    head, kinds = "<h1 id=lead>T</h1>", "<div id=kinds>%s</div><div id=kinds>alpine</div>"
    pages = one_page(("h", head), ("r", kinds % "Alpine x"), ("hre", head + kinds % "Alpine herb"), ("-", "<p>x</p>"))
    library = lib([{"ruleName": "v", "rulePreconditionType": mode, "rulePreconditionExpression": expr, "rulePreconditions": CONDITIONS, "ruleCSSSelector": "*", **TEXT, "ruleReturnedMatchPos": 0}])
    got = {r["url"]: r["v"] for r in apply_library(pages, library).collect()}
    assert {u for u, v in got.items() if v != ""} == kept
    assert set(got) == {"h", "r", "hre", "-"}  # a failed precondition leaves ''


def test_eval_without_expression_skips_the_rule(one_page):
    library = lib([{"ruleName": "v", "rulePreconditionType": "EVAL", "rulePreconditions": CONDITIONS, "ruleCSSSelector": "h1", **TEXT}])
    assert apply_library(one_page(("u", "<h1 id=lead>T</h1>")), library).first()["v"] is None


def test_selector_override(one_page):
    rows = "".join(f"<tr><th class=job>{{{i}}}</th><td class=who>a{i}</td></tr>" for i in range(4))
    rule = {
        "ruleName": "keeper", "rulePreconditionType": "ANY", "ruleCSSSelector": "h1", **TEXT,
        "rulePreconditions": [
            {"ecCSSSelector": f"tr:nth-child({i}) .job", "ecTextCondition": "^Keeper$", "ecRuleCSSSelector": f"tr:nth-child({i}) .who"}
            for i in (1, 2, 3)
        ] + [{"ecCSSSelector": "h1"}],
    }
    zoo = "<h1>Zoo</h1><table>" + rows + "</table>"
    pages = one_page(("a", zoo.format("x", "Keeper", "Keeper", "")), ("b", zoo.format("", "", "Keeper", "")), ("c", zoo.format(*"abcd")), ("d", "<h2>"))
    got = {r["url"]: r["keeper"] for r in apply_library(pages, lib([rule])).collect()}
    assert got == {"a": "a1", "b": "a2", "c": "Zoo", "d": ""}


RECIPE = lib(
    [
        {"ruleName": "dish", "ruleCSSSelector": "header", **TEXT},
        {"ruleName": "steps", "ruleCSSSelector": "section.step", **TEXT, "ruleReturnsMore": True, "ruleRemoveChars": ["(", ")*"],
         "ruleMatchPreconditions": [{"ecCSSSelector": "time[min]", "ecTextCondition": r"\d\d"}],
         "rulePostCSSSelector": ["b", "time", "em ~ i"], "ruleReturnedValueNames": ["verb", "minutes", "tool", "spare"]},
    ],
    ["verb", "minutes", "tool", "dish"],
    minimum=0.7,
)


def recipe_page(steps):
    made = "".join(f"<section class='on step'><b>{v}</b><i>-</i><time min=1>{m}</time>" + ("" if t is None else f"<em>by</em><u>a</u><i>{t}</i>") + "</section>" for v, m, t in steps)
    return f"<header>Stew</header>{made}<section class=step><b>Note</b><time>99</time></section><section class=tip><time min=1>77</time></section>"


def test_records_of_chosen_matches(one_page):
    page = recipe_page([("Fry(2)*", 12, "pan"), ("Rest", 3, "bowl"), ("Boil*", 40, None), ("Cool", 55, "")])
    # Rest takes less than ten minutes; Boil and Cool have two of three fields: 0.67 < 0.7
    assert records(one_page(("u", page)), RECIPE) == [("u", "Fry2", "12", "pan", None)]
    assert records(one_page(("u", page)), RECIPE, gate=False) == [
        ("u", "Boil", "40", "", None), ("u", "Cool", "55", "", None), ("u", "Fry2", "12", "pan", None),
    ]
    assert records(one_page(("u", page)), RECIPE, attach_scalars=True)[0][-1] == "Stew"


def test_a_page_without_chosen_matches_is_one_record(one_page):
    assert records(one_page(("u", "<header>Stew</header>")), RECIPE) == [("u", None, None, None, "Stew")]


def test_match_replacement_with_attribute(one_page):
    rule = {
        "ruleName": "getLinks", "ruleCSSSelector": "tr", "ruleTargetAttribute": "href", "ruleReturnsMore": True,
        "ruleMatchPreconditions": [{"ecCSSSelector": "tr td:nth-child(3)", "ecTextCondition": "SHA-256", "ecRuleCSSSelector": "tr td:nth-child(1) a[href]"}],
    }
    rows = "<tr><td><a href='/m/1'>x</a><td>y<td>SHA-256<tr><td><a href=/m/2>x</a><td>y<td>Scrypt<tr><td>no link<td>y<td>SHA-256<tr><td><a href='#top'>x</a><td><td>SHA-256"
    pages = one_page(("http://h.example/list/", f"<table>{rows}</table>"))
    assert apply_library(pages, lib([rule])).first()["getLinks"] == ["/m/1", "#top"]
    edges = extract_links(pages, lib([rule])).collect()
    assert [tuple(e) for e in edges] == [("http://h.example/list/", "http://h.example/m/1", 0)]


def test_missing_replacement_in_other_shapes(one_page):
    match_pre = [{"ecCSSSelector": "a", "ecRuleCSSSelector": "b"}]
    base = {"ruleCSSSelector": "li", "ruleMatchPreconditions": match_pre}
    rules = [
        {**base, "ruleName": "single", **TEXT},
        {**base, "ruleName": "list", **TEXT, "ruleReturnsMore": True},
        {**base, "ruleName": "attrs", "ruleTargetAttribute": "class"},
        {**base, "ruleName": "attr1", "ruleTargetAttribute": "class", "ruleReturnedMatchPos": 1},
        {**base, "ruleName": "recs", **TEXT, "ruleReturnsMore": True, "rulePostCSSSelector": ["b"], "ruleReturnedValueNames": ["x"]},
        {**base, "ruleName": "named", **TEXT, "ruleReturnsMore": True, "ruleReturnedValueNames": ["n1"]},
        {**base, "ruleName": "named2", **TEXT, "ruleReturnsMore": True, "ruleReturnedValueNames": ["m1", "m2"]},
    ]
    html = "<ul><li><a>1</a><b class=k>one</b><li><a>2</a></ul>"
    row = apply_library(one_page(("u", html)), lib(rules)).first()
    assert row["single"] is None and row["list"] == ["one"] and row["attrs"] == ["k"] and row["attr1"] is None
    assert row["recs"] is None and row["n1"] == "one" and row["m1"] is None


def test_values_in_scripts(one_page):
    js = {"ruleTarget": "js"}
    rules = [
        {**js, "ruleName": "total", "ruleContentCondition": r"\btotal *= *(-?\d+)"},
        {**js, "ruleName": "unit", "ruleContentCondition": r'"unit":\s*"(\w+)"'},
        {**js, "ruleName": "absent", "ruleContentCondition": r"missing=(.)"},
        {**js, "ruleName": "without_group", "ruleContentCondition": "total"},
        {**js, "ruleName": "replaced", "ruleContentCondition": "q", "rulePreconditions": [{"ecCSSSelector": "p", "ecRuleCSSSelector": r"id:(\w+);"}]},
    ]
    html = "<p>total = 1; id:no;</p><script>if (1 < 2) { total =\t3; total = -41; } // id:k8;</script><script type=x>{\"unit\":\n\"mm\"}</script>"
    row = apply_library(one_page(("u", html)), lib(rules)).first()
    assert [row[r["ruleName"]] for r in rules] == ["-41", "mm", None, None, "k8"]


def test_mixed_detail_and_listing(one_page):
    library = lib(
        [
            {"ruleName": "place", "ruleURLActivationCondition": ["/detail/"], "ruleCSSSelector": "h1", **TEXT},
            {"ruleName": "price", "ruleURLActivationCondition": ["/detail/"], "ruleCSSSelector": ".price", **TEXT, "ruleRemoveChars": ["€", "."]},
            {"ruleName": "found", "ruleURLActivationCondition": ["/search"], "ruleCSSSelector": "article", **TEXT, "ruleReturnsMore": True,
             "rulePostCSSSelector": ["h2", "b"], "ruleReturnedValueNames": ["place", "price"]},
        ],
        ["place", "price"],
        minimum=0.5,
    )
    pages = one_page(
        ("http://h/detail/1", "<h1> Rome</h1><i class=price>€1.200</i>"),
        ("http://h/detail/2", "<h2>nothing</h2>"),
        ("http://h/search", "<article><h2>A</h2><b>1</b></article><article><h2>B</h2></article><article></article>"),
        ("http://h/other", "<h1>x</h1>"),
    )
    assert records(pages, library) == [
        ("http://h/detail/1", "Rome", "1200"), ("http://h/search", "A", "1"), ("http://h/search", "B", ""),
    ]


def test_positions_and_lists(one_page):
    li = {"ruleCSSSelector": "li", **TEXT}
    rules = [
        {**li, "ruleName": "last"},
        {**li, "ruleName": "second", "ruleReturnedMatchPos": 1, "ruleRemoveChars": ["bb", "!"]},
        {**li, "ruleName": "back", "ruleReturnedMatchPos": -3},
        {**li, "ruleName": "beyond", "ruleReturnedMatchPos": 3},
        {**li, "ruleName": "far", "ruleReturnedMatchPos": -4},
        {**li, "ruleName": "all", "ruleReturnsMore": True, "ruleContentCondition": "^[ab]"},
        {**li, "ruleName": "one", "ruleContentCondition": "^a"},
        {"ruleName": "none", "ruleCSSSelector": "table", **TEXT},
        {"ruleName": "nones", "ruleCSSSelector": "table", **TEXT, "ruleReturnsMore": True},
        {"ruleName": "noattr", "ruleCSSSelector": "li", "ruleTargetAttribute": "id", "ruleReturnedMatchPos": 0},
        {"ruleName": "ids", "ruleCSSSelector": "li", "ruleTargetAttribute": "id"},
        {"ruleName": "id1", "ruleCSSSelector": "li", "ruleTargetAttribute": "id", "ruleReturnedMatchPos": 1, "ruleReturnsMore": True},
        {"ruleName": "id9", "ruleCSSSelector": "li", "ruleTargetAttribute": "id", "ruleReturnedMatchPos": 9},
        {"ruleName": "noids", "ruleCSSSelector": "table", "ruleTargetAttribute": "id"},
        {**li, "ruleName": "n", "ruleReturnsMore": True, "ruleReturnedValueNames": ["n0", "n1", "n2", "n3"]},
    ]
    row = apply_library(one_page(("u", "<ul><li>a<li id=x>bb!<li>c</ul>")), lib(rules)).first().asDict()
    want = {
        "last": "c", "second": "", "back": "a", "beyond": None, "far": None, "all": ["a", "bb!"], "one": "a", "none": "", "nones": [],
        "noattr": None, "ids": [None, "x", None], "id1": ["x"], "id9": None, "noids": [], "n0": "a", "n1": "bb!", "n2": "c", "n3": None, "n": None,
    }
    assert {k: row[k] for k in want} == want


def test_later_rule_wins_even_without_a_value(one_page):
    rules = [
        {"ruleName": "v", "ruleCSSSelector": "h1", **TEXT},
        {"ruleName": "v", "ruleURLActivationCondition": ["attr"], "ruleCSSSelector": "h1", "ruleTargetAttribute": "id", "ruleReturnedMatchPos": 0},
        {"ruleName": "v", "ruleURLActivationCondition": ["far"], "ruleCSSSelector": "h1", **TEXT, "ruleReturnedMatchPos": 5},
        {"ruleName": "v", "ruleURLActivationCondition": ["list"], "ruleCSSSelector": "h1", **TEXT, "ruleReturnsMore": True},
    ]
    pages = one_page(*[(u, "<h1>T</h1>") for u in ("plain", "attr", "far", "list")])
    got = {r["url"]: r["v"] for r in apply_library(pages, lib(rules)).collect()}
    assert got == {"plain": ["T"], "attr": None, "far": ["T"], "list": ["T"]}


def test_required_lists_and_unknown_fields(one_page):
    rules = [{"ruleName": "tags", "ruleCSSSelector": "li", **TEXT, "ruleReturnsMore": True}, {"ruleName": "t", "ruleCSSSelector": "h1", **TEXT}]
    pages = one_page(("a", "<h1>x</h1><li>1<li>2"), ("b", "<h1>x</h1>"))
    assert records(pages, lib(rules, ["tags", "t"], ["tags"])) == [("a", '["1","2"]', "x")]
    assert records(pages, lib(rules, ["tags", "t"], ["zzz"])) == []
    assert records(pages, lib(rules, ["nope"])) == []


def test_two_record_lists(one_page):
    def listing(name, css, **more):
        return {"ruleName": name, "ruleCSSSelector": css, **TEXT, "ruleReturnsMore": True, "rulePostCSSSelector": ["b"], "ruleReturnedValueNames": ["x"], **more}

    pages = one_page(("u/1", "<li><b>1</b><p><b>2</b></p>"), ("u/2", "<p><b>3</b></p>"))
    with pytest.raises(ValueError):
        extract(pages, lib([listing("a", "li"), listing("b", "p")], ["x"]))
    library = lib([listing("a", "ul"), listing("a2", "li", ruleURLActivationCondition=["u"]), listing("b", "p", ruleURLActivationCondition=["u"])], ["x"])
    library = Library(rules=library.rules[1:], csv_cols=library.csv_cols)
    assert records(pages, library) == [("u/1", "1"), ("u/2", "3")]
    assert [tuple(r) for r in record_list_conflicts(pages, library).collect()] == [("u/1", 2)]


def test_preview_and_single_rule(one_page):
    pages = one_page(("u", recipe_page([("Fry", 12, "pan")])))
    rows = preview(pages, RECIPE).orderBy("rule").collect()
    assert [(r["rule"], r["kind"], r["pos"], r["value"]) for r in rows] == [
        ("dish", "scalar", 0, "Stew"), ("steps", "records", 0, '{"verb":"Fry","minutes":"12","tool":"pan"}'),
    ]
    assert preview(pages, RECIPE, "dish").count() == 1
    assert apply_rule(pages, RECIPE, "dish").columns == ["page_id", "url", "dish"]
    with pytest.raises(KeyError):
        apply_rule(pages, RECIPE, "none")
    more = RECIPE.with_rule({"ruleName": "tip", "ruleCSSSelector": ".tip", **TEXT})
    assert apply_rule(pages, more, "tip").first()["tip"] == "77"


def test_statistics(one_page):
    library = lib(
        [
            {"ruleName": "t", "ruleURLActivationCondition": ["u"], "ruleCSSSelector": "li", **TEXT, "ruleReturnsMore": True, "rulePreconditionType": "ANY",
             "rulePreconditions": [{"ecName": "h", "ecCSSSelector": "h1", "ecTextCondition": "x"}, {"ecCSSSelector": "li"}]},
            {"ruleName": "a", "ruleCSSSelector": "li", "ruleTargetAttribute": "id"},
            {"ruleName": "e", "ruleCSSSelector": "li", **TEXT, "rulePreconditionType": "EVAL", "rulePreconditions": [{"ecName": "h", "ecCSSSelector": "h1"}]},
            {"ruleName": "s", "ruleCSSSelector": "li", **TEXT, "rulePreconditionType": "some", "rulePreconditions": [{"ecName": "h", "ecCSSSelector": "h1"}]},
        ]
    )
    pages = one_page(("u1", "<h1>x</h1><li>1<li>2"), ("u2", "<h1>y</h1><li>1"), ("u3", "<p>"), ("v", "<li>1"))
    assert [tuple(r) for r in rule_stats(pages, library).orderBy("rule_pos").collect()] == [
        (0, "t", 3, 2, 3, 1), (1, "a", 4, 4, 0, 0), (2, "e", 4, 0, 0, 4), (3, "s", 4, 0, 0, 0),
    ]
    assert [tuple(r) for r in condition_stats(pages, library).where("rule_name = 't'").orderBy("cond_pos").collect()] == [
        ("t", 0, "h", 3, 2, 1, 2), ("t", 1, "", 2, 1, 1, 1),
    ]
