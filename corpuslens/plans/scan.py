"""Scan search: test every file, match names or lines, count what happened."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import file_text
from corpuslens.operators.bounded import shared_folder
from corpuslens.operators.filters import BINARY_PROBE, is_binary, skip_reason
from corpuslens.operators.match import check_pattern, content_matches, name_matches
from corpuslens.schema import SEARCH_STATS, SOURCE_SCAN, SearchOptions
from corpuslens.sources.tree import files_of, list_tree, with_content


def counters() -> list:
    """Run counters over flagged files; scanned and skipped are independent flags."""
    return [
        F.count_if("scanned").alias("files_scanned"),
        F.count_if("matched").alias("matches_found"),
        F.count_if("skipped").alias("files_skipped"),
    ]


def scan_flags(files: DataFrame, options: SearchOptions) -> DataFrame:
    """Files ``(path, name, extension, size, content, text)`` with reason and flags, no shuffle.

    ``text`` is needed for a content search only.
    """
    if options.use_regex:
        check_pattern(files.sparkSession, options.search_term)
    if options.search_content:
        hit = content_matches(F.col("text"), options.search_term, options.use_regex,
                              options.case_sensitive)
    else:
        hit = name_matches(F.col("name"), options.search_term, options.use_regex,
                           options.case_sensitive)
    reason = skip_reason(options, is_binary(F.col("content")))
    return (files
            .withColumn("skip_reason", reason)
            .withColumn("scanned", F.col("skip_reason").isNull())
            .withColumn("skipped", F.col("skip_reason").isNotNull())
            .withColumn("matched", F.when(F.col("scanned"), hit).otherwise(F.lit(False))))


def scan_hits(flags: DataFrame) -> DataFrame:
    """One row per matching file; a scan gives no snippet."""
    return flags.filter("matched").select(
        "path", F.lit("").alias("snippet"), F.lit(SOURCE_SCAN).alias("source"))


def scan_stats(flags: DataFrame) -> DataFrame:
    return flags.agg(*counters())


def scan_search(files: DataFrame, options: SearchOptions,
                observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """``(hits, stats)``; with an observation the counters also come with the hits, in one pass."""
    flags = scan_flags(files, options)
    watched = flags.observe(observation, *counters()) if observation else flags
    return scan_hits(watched), scan_stats(flags)


def scan_once(files: DataFrame, options: SearchOptions) -> tuple[DataFrame, DataFrame]:
    """``scan_search`` now and in one pass: every file is read once, its hits are written, and the
    counters are those of the same pass."""
    spark, seen = files.sparkSession, Observation(f"scan-{uuid.uuid4().hex}")
    hits, _ = scan_search(files, options, seen)
    place = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    hits.write.parquet(place)
    counted = tuple(seen.get[name] for name in SEARCH_STATS.names)
    return (spark.read.schema(hits.schema).parquet(place),
            spark.createDataFrame([counted], SEARCH_STATS))


def unlisted(listing: DataFrame) -> DataFrame:
    """``path, error`` of the directories of a listing that could not be read."""
    return (listing.filter(F.col("is_directory") & F.col("listing_error").isNotNull())
            .select("path", F.col("listing_error").alias("error")))


def tree_files(spark: SparkSession, options: SearchOptions,
               listing: DataFrame | None = None) -> DataFrame:
    """The files below the root, read as far as the search needs them.

    Files that fail a test on metadata are not opened, and a name search reads only the bytes
    of the binary test. A directory that could not be listed is kept as an unreadable entry: it
    counts as skipped.
    """
    listing = list_tree(spark, options.root_directory) if listing is None else listing
    entries = listing.filter(~F.col("is_directory") | F.col("listing_error").isNotNull())
    passes = skip_reason(options, F.lit(False)).isNull() & F.col("listing_error").isNull()
    head = None if options.search_content else BINARY_PROBE
    return (with_content(entries, head, passes)
            .withColumn("text", file_text(F.col("content"))))


def scan_tree(spark: SparkSession, options: SearchOptions,
              observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    return scan_search(tree_files(spark, options), options, observation)


def indexable_tree(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of the files below a root, as the indexer takes them; bad directories drop out."""
    return files_of(list_tree(spark, root))
