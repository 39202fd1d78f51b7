"""Versioned tables: data goes to ``<root>/v=<n>``, then a manifest row names it.

The manifest row is appended last, so a write that fails half-way is never read. One writer at
a time is assumed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("version", T.IntegerType(), False),
    T.StructField("base", T.IntegerType(), False),
    T.StructField("buckets", T.IntegerType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_removed", T.LongType()),
])


def version_path(root: str, version: int, part: str | None = None) -> str:
    return f"{root}/v={version}" + (f"/{part}" if part else "")


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest(spark: SparkSession, root: str) -> dict | None:
    """The live version's manifest row, or None where nothing was published."""
    rows = manifest(spark, root)
    if rows is None:
        return None
    found = rows.orderBy(F.desc("version")).limit(1).collect()
    return found[0].asDict() if found else None


def chain(spark: SparkSession, root: str, entry: dict) -> list[dict]:
    """Manifest rows of the versions that make up the live one, its base first."""
    rows = manifest(spark, root).filter(F.col("version").between(entry["base"], entry["version"]))
    return [r.asDict() for r in rows.orderBy("version").collect()]


def publish(spark: SparkSession, root: str, *, version: int, base: int | None = None,
            buckets: int | None = None, n_docs: int | None = None,
            n_removed: int | None = None) -> None:
    row = (version, version if base is None else base, buckets, n_docs, n_removed)
    (spark.createDataFrame([row], MANIFEST).coalesce(1)
     .write.mode("append").parquet(f"{root}/manifest"))
