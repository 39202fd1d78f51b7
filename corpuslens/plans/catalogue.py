"""The metadata catalogue of a file tree, kept as versioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.versions import latest, publish, version_path
from corpuslens.schema import CATALOGUE
from corpuslens.sources.tree import list_tree


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per file and directory below ``root``."""
    return list_tree(spark, root).select(*CATALOGUE.names)


def build_catalogue(spark: SparkSession, root: str, target: str) -> DataFrame:
    """List the tree into a new version, then make that version the live one.

    A rebuild is the same call: readers keep the old version until the new one is complete.
    """
    entry = latest(spark, target)
    version = 1 if entry is None else entry["version"] + 1
    catalogue(spark, root).write.mode("overwrite").parquet(version_path(target, version))
    publish(spark, target, version=version)
    return open_catalogue(spark, target)


def open_catalogue(spark: SparkSession, target: str) -> DataFrame:
    entry = latest(spark, target)
    if entry is None:
        raise ValueError(f"no catalogue at {target}")
    return spark.read.schema(CATALOGUE).parquet(version_path(target, entry["version"]))


def catalogue_status(entries: DataFrame) -> DataFrame:
    """How many entries the catalogue holds."""
    return entries.agg(F.count("*").alias("entries"))
