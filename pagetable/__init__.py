"""pagetable: rule-based extraction of tables from captured web pages, as Spark plans."""

from pagetable.operators.dom import attr_of, parse_dom, text_of
from pagetable.operators.selectors import find_first, match_count, matches_frame, select
from pagetable.plans.crawl import CrawlResult, crawl, resume
from pagetable.plans.extraction import (
    active_rules,
    apply_library,
    apply_rule,
    extract,
    extract_links,
    preview,
)
from pagetable.plans.library import Condition, Library, Rule
from pagetable.plans.refresh import refresh
from pagetable.plans.statistics import condition_stats, rule_stats
from pagetable.sources.libraries import library_catalog, load_library, load_rules
from pagetable.sources.pages import read_pages, read_seeds, stream_pages
from pagetable.streaming.pages import stream_extract

__all__ = [
    "Condition", "CrawlResult", "Library", "Rule", "active_rules", "apply_library", "apply_rule", "attr_of",
    "condition_stats", "crawl", "extract", "extract_links", "find_first", "library_catalog", "load_library",
    "load_rules", "match_count", "matches_frame", "parse_dom", "preview", "read_pages", "read_seeds", "refresh",
    "resume", "rule_stats", "select", "stream_extract", "stream_pages", "text_of",
]
