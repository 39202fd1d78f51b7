"""Corpora that are tables already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.paths import extension, file_name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files_view(docs: DataFrame) -> DataFrame:
    """A file tree over a documents table: ``doc_id, path, text, mtime_us``."""
    endings = F.array(*[F.lit(e) for e in (".txt", ".md", ".LOG", ".py", ".bin", "")])
    return docs.select(
        "doc_id",
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc"),
                 F.col("doc_id").cast("string"),
                 F.get(endings, (F.col("doc_id") % 6).cast("int"))).alias("path"),
        "text",
        (F.col("doc_id") * 1_000_000).alias("mtime_us"),
    )


def with_metadata(files: DataFrame) -> DataFrame:
    """Add to ``path, text`` what a listing would give: ``name, extension, size, content``."""
    return (files
            .withColumn("name", file_name(F.col("path")))
            .withColumn("extension", extension(F.col("name")))
            .withColumn("size", F.octet_length("text").cast("bigint"))
            .withColumn("content", F.col("text").cast("binary")))
