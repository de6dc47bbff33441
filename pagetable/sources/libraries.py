"""Rule libraries from files: plain JSON or the relaxed form with `#` comments, True/False,
optional commas and unescaped backslashes in patterns. The text is put right by built-in string
functions and read by Spark's JSON reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetable.plans.library import Library
from pagetable.schemas import LIBRARY

_QUOTED = r'"(?:[^"\\\n]|\\.)*+"'


def _strict_json(text: Column) -> Column:
    steps = [
        # comments outside quotes
        (rf'(?m)^((?:[^"#\n]|{_QUOTED})*+)#.*$', "$1"),
        # backslashes that start no JSON escape belong to a pattern
        (r'(?<!\\)((?:\\\\)*)\\(?!["\\nrt]|u[0-9A-Fa-f]{4})', r"$1\\\\"),
        (r'("\s*:\s*)True\b', "$1true"),
        (r'("\s*:\s*)False\b', "$1false"),
        # a line end between two members, or between two elements, stands for a comma
        (r'(["\]}0-9el])([ \t\r]*\n\s*)(?=["{])', "$1,$2"),
        # repeated and trailing commas outside quotes
        (rf"({_QUOTED})|(,)(?:\s*,)+", "$1$2"),
        (rf"({_QUOTED})|,(\s*[\]}}])", "$1$2"),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """(lib, unreadable, <library fields>) per library file below `path`."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    parsed = files.select(
        F.col("_metadata.file_path").alias("lib"),
        F.from_json(_strict_json(F.col("value")), LIBRARY, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}).alias("l"),
    )
    return parsed.select("lib", F.col("l.library").isNull().alias("unreadable"), "l.*")


def load_library(spark: SparkSession, path: str) -> Library:
    """One library file as plan input. A library is configuration: one small row."""
    rows = read_libraries(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one library file")
    if rows[0]["unreadable"]:
        raise ValueError(f"cannot read rule library {path}")
    return Library.from_dict(rows[0].asDict(recursive=True))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all libraries below `path`, one row each, with defaults filled in."""
    rules = read_libraries(spark, path).where("not unreadable").select("lib", F.posexplode("library").alias("rule_pos", "r"))

    def text(name, default=""):
        return F.coalesce(F.col(f"r.{name}"), F.lit(default))

    def items(name):
        return F.coalesce(F.col(f"r.{name}"), F.array().cast("array<string>"))

    def conditions(name):
        filled = F.transform(
            F.col(f"r.{name}"),
            lambda c: F.struct(
                F.coalesce(c["ecName"], F.lit("")).alias("name"),
                F.coalesce(c["ecCSSSelector"], F.lit("")).alias("css"),
                F.coalesce(c["ecTextCondition"], F.lit("")).alias("regex"),
                F.coalesce(c["ecRuleCSSSelector"], F.lit("")).alias("rule_css"),
            ),
        )
        return F.coalesce(filled, F.array().cast("array<struct<name:string,css:string,regex:string,rule_css:string>>"))

    return rules.select(
        "lib",
        "rule_pos",
        text("ruleName").alias("rule_name"),
        text("ruleDescription").alias("descr"),
        items("ruleURLActivationCondition").alias("url_patterns"),
        text("ruleTarget", "html").alias("target"),
        text("ruleCSSSelector").alias("css"),
        text("ruleTargetAttribute").alias("attr"),
        text("ruleContentCondition").alias("content_regex"),
        text("rulePreconditionType", "ANY").alias("pre_type"),
        text("rulePreconditionExpression").alias("pre_expr"),
        conditions("rulePreconditions").alias("pre"),
        conditions("ruleMatchPreconditions").alias("match_pre"),
        F.coalesce("r.ruleReturnsMore", F.lit(False)).alias("returns_more"),
        F.coalesce("r.ruleReturnedMatchPos", F.lit(-1)).alias("match_pos"),
        items("rulePostCSSSelector").alias("post_css"),
        items("ruleReturnedValueNames").alias("value_names"),
        items("ruleRemoveChars").alias("remove"),
    )


def library_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, descr, n_rules) of the readable libraries below `path`."""
    libs = read_libraries(spark, path).where("not unreadable")
    return libs.select(
        F.element_at(F.split("lib", "/"), -1).alias("file_name"),
        F.coalesce("libraryDescription", F.lit("")).alias("descr"),
        F.size("library").alias("n_rules"),
    )


def describe_library(rules: DataFrame) -> DataFrame:
    """One row per rule and precondition (one for a rule without any)."""
    return rules.select(
        "lib",
        "rule_pos",
        "rule_name",
        "descr",
        F.array_join("url_patterns", " | ").alias("activation"),
        "pre_type",
        F.size("pre").alias("n_preconditions"),
        "css",
        F.posexplode_outer("pre").alias("cond_pos", "_c"),
    ).select("*", F.col("_c.name").alias("cond_name"), F.col("_c.css").alias("cond_css"), F.col("_c.regex").alias("cond_regex")).drop("_c")
