"""How often rules and conditions fired: one pass over the pages, one row per rule or condition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetable.operators.shaping import content_filter, has_gap
from pagetable.plans.extraction import LibraryPlan, _may_have_gaps, _parsed
from pagetable.plans.library import Library, Rule


def _counted(pages: DataFrame, lib: Library) -> tuple[LibraryPlan, DataFrame]:
    narrow = pages if "dom" in pages.columns else pages.select("url", "html")
    plan = LibraryPlan(lib)
    return plan, plan.working_columns(_parsed(narrow, lib))


def _match_count(i: int, rule: Rule) -> Column:
    """Matches counted by text rules; attribute and script rules count none."""
    if rule.shape in ("script", "attr"):
        return F.lit(0)
    m = F.col(f"_m{i}")
    kept = content_filter(m, rule.content_regex)
    if rule.shape == "text":
        n = (F.size(kept) > 0).cast("int")
    elif rule.shape == "texts":
        n = F.size(F.filter(kept, lambda e: e.isNotNull()))
    else:
        n = F.size(kept)
    if _may_have_gaps(rule) and (rule.content_regex or rule.shape in ("named", "records")) and rule.shape != "text":
        # the rule failed on the page before its matches were counted
        read = F.slice(m, 1, len(rule.value_names)) if rule.shape == "named" and not rule.content_regex else m
        n = F.when(has_gap(read), F.lit(0)).otherwise(n)
    return F.coalesce(n, F.lit(0))


def rule_stats(pages: DataFrame, lib: Library) -> DataFrame:
    """(rule_pos, rule_name, url_matched, applied, matches, precondition_failed) per rule."""
    _, work = _counted(pages, lib)
    known = ("any", "all", "eval")
    sums = []
    for i, r in enumerate(lib.rules):
        active, held = F.col(f"_u{i}"), F.col(f"_p{i}")
        fails = active & ~F.coalesce(held, F.lit(False)) if r.pre and r.pre_type.lower() in known else F.lit(False)
        sums += [
            F.count_if(active).alias(f"u{i}"),
            F.count_if(F.coalesce(held, F.lit(False))).alias(f"a{i}"),
            F.coalesce(F.sum(_match_count(i, r).cast("long")), F.lit(0)).cast("long").alias(f"m{i}"),
            F.count_if(fails).alias(f"f{i}"),
        ]
    totals = work.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_pos"),
                F.lit(r.name).alias("rule_name"),
                F.col(f"u{i}").alias("url_matched"),
                F.col(f"a{i}").alias("applied"),
                F.col(f"m{i}").alias("matches"),
                F.col(f"f{i}").alias("precondition_failed"),
            )
            for i, r in enumerate(lib.rules)
        ]
    )
    return totals.select(F.inline(rows))


def condition_stats(pages: DataFrame, lib: Library) -> DataFrame:
    """(rule_name, cond_pos, cond_name, applied, exists_count, true_count, false_count) per page condition.

    ANY and ALL stop at the first decisive condition, so later ones are not counted on that page.
    """
    plan, work = _counted(pages, lib)
    sums, rows = [], []
    for i, r in enumerate(lib.rules):
        mode = r.pre_type.lower()
        flags = [F.col(f) for f in plan.flags(r)]
        for j, c in enumerate(r.pre):
            reached = F.col(f"_u{i}")
            if mode in ("any", "all"):
                earlier = [~f if mode == "any" else f for f in flags[:j]]
                reached = reduce(lambda a, b: a & b, earlier, reached)
            elif mode != "eval" or not c.name.strip() or not r.pre_expr.strip():
                reached = F.lit(False)
            there = F.coalesce(F.size(plan.matched(c.css)) > 0, F.lit(False))
            k = f"{i}_{j}"
            sums += [
                F.count_if(reached).alias(f"a{k}"),
                F.count_if(reached & there).alias(f"e{k}"),
                F.count_if(reached & flags[j]).alias(f"t{k}"),
                F.count_if(reached & ~flags[j]).alias(f"f{k}"),
            ]
            rows.append(
                F.struct(
                    F.lit(r.name).alias("rule_name"),
                    F.lit(j).alias("cond_pos"),
                    F.lit(c.name).alias("cond_name"),
                    F.col(f"a{k}").alias("applied"),
                    F.col(f"e{k}").alias("exists_count"),
                    F.col(f"t{k}").alias("true_count"),
                    F.col(f"f{k}").alias("false_count"),
                )
            )
    if not rows:
        schema = "rule_name string, cond_pos int, cond_name string, applied long, exists_count long, true_count long, false_count long"
        return pages.sparkSession.createDataFrame([], schema)
    return work.agg(*sums).select(F.inline(F.array(*rows)))
