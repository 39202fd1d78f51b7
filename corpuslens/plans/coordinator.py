"""One search as the user asks for it: which mode applies, then a scan or an index search."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.bounded import settle
from corpuslens.operators.clauses import query_table
from corpuslens.plans.index import Index, index_exists, open_index
from corpuslens.plans.retrieve import index_search, refuse_errors
from corpuslens.plans.scan import scan_once, tree_files, unlisted
from corpuslens.schema import COORDINATOR_HITS, SEARCH_STATS, SearchOptions
from corpuslens.sources.tree import is_file, list_tree

# What the user is told.
NO_REGEX = "Regex search is not available when using the content index."
REGEX_SCAN = "Regex search requested. Falling back to scan mode."
NO_INDEX = "No content index found at '{}'."
NO_INDEX_SCAN = "No content index found. Falling back to scan mode."
SEARCHING = "Searching content index: {}"
NOT_FOUND = "Warning: Directory not found: {}. Skipping."
DENIED = "Warning: Access denied to directory: {}. Skipping."
RESULT = "path string, snippet string, source string"


@dataclass(frozen=True)
class SearchOutcome:
    """Hits ``(path, snippet, source)``, one row of counters, and messages ``(level, text)``.

    Directories that could not be listed are rows ``path, error`` of ``unlisted`` too, where a
    tree was scanned. Each has its message; beyond ``bounded.SMALL_ROWS`` of them the messages
    say how many there are, and the table holds them all.
    """

    hits: DataFrame
    stats: DataFrame
    messages: list[tuple[str, str]] = field(default_factory=list)
    unlisted: DataFrame | None = None


def resolve(options: SearchOptions, index_present: bool) -> tuple[str, list[tuple[str, str]]]:
    """``scan``, ``index`` or ``none`` (nothing can be searched), with messages."""
    mode = options.mode()
    if not options.search_content or mode == "scan":
        return "scan", []
    if options.use_regex:
        return ("none", [("warning", NO_REGEX)]) if mode == "index" else (
            "scan", [("status", REGEX_SCAN)])
    if not index_present:
        missing = NO_INDEX.format(options.content_index_path or "")
        return ("none", [("warning", missing)]) if mode == "index" else (
            "scan", [("status", NO_INDEX_SCAN)])
    return "index", []


def _scan_of_tree(spark: SparkSession, options: SearchOptions,
                  messages: list[tuple[str, str]]) -> SearchOutcome:
    """One pass over the tree. A root that is not there is a warning and counts as skipped."""
    root = options.root_directory
    if not os.path.isdir(root):
        return SearchOutcome(
            spark.createDataFrame([], RESULT), spark.createDataFrame([(0, 0, 1)], SEARCH_STATS),
            [*messages, ("warning", NOT_FOUND.format(root))],
            spark.createDataFrame([(root, "not found")], "path string, error string"))
    listing = list_tree(spark, root)
    hits, stats = scan_once(tree_files(spark, options, listing), options)
    bad, rows = settle(unlisted(listing))
    told = ([("warning", f"Warning: {bad.count()} directories could not be read.")]
            if rows is None else
            [("warning", (NOT_FOUND if r["error"] == "not found" else DENIED).format(r["path"]))
             for r in sorted(rows, key=lambda r: r["path"])])
    return SearchOutcome(hits, stats, [*messages, *told], bad)


def index_stats(hits: DataFrame) -> DataFrame:
    """An index search counts its results only."""
    zero = F.lit(0).cast("bigint")
    return hits.agg(F.count("*").alias("found")).select(
        zero.alias("files_scanned"), F.col("found").alias("matches_found"),
        zero.alias("files_skipped"))


def search(spark: SparkSession, options: SearchOptions, *, files: DataFrame | None = None,
           index: Index | None = None, live: DataFrame | None = None) -> SearchOutcome:
    """Search ``files`` (or the tree at the root) or ``index``, by the mode rules.

    Without ``index``, one at ``options.content_index_path`` is opened if it is there; its hits
    are then files, and those that no longer exist are dropped. An index search looks at the
    text, case, fuzzy and phrase options only; a scan at all others.
    A malformed query or pattern raises ``ValueError`` before any file is read.
    """
    on_disk = index is None and options.search_content and index_exists(
        spark, options.content_index_path)
    action, messages = resolve(options, index is not None or on_disk)
    if action == "none":
        return SearchOutcome(spark.createDataFrame([], RESULT),
                             spark.createDataFrame([(0, 0, 0)], SEARCH_STATS), messages)
    if action == "scan":
        if files is None:
            return _scan_of_tree(spark, options, messages)
        return SearchOutcome(*scan_once(files, options), messages)
    query = query_table(spark, [(1, options.search_term, options.case_sensitive,
                                 options.fuzzy_search, options.exact_phrase, COORDINATOR_HITS)])
    refuse_errors(query)
    if on_disk:
        messages = [*messages, ("status", SEARCHING.format(options.content_index_path))]
    hits = index_search(index or open_index(spark, options.content_index_path), query, live)
    if on_disk and live is None:
        hits = hits.filter(is_file("path"))
    hits = hits.orderBy("rank").select("path", "snippet", "source")
    return SearchOutcome(hits, index_stats(hits), messages)
