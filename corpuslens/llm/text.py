"""Small column helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.bounded import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; a text of ASCII only takes the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that no model may learn from, by the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def plain_sql(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of tables that have been written and are used no more, and
    forget their plans. It does so when the driver collects garbage, which it puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, *folders: str) -> DataFrame:
    """The table written to the shared folder and read again: like a checkpoint, but by column,
    which takes a fraction of the space where rows are many and short."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
