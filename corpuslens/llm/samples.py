"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import held_out


def _known(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` of the ids that may be taken, once each."""
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()
                    & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.min("label").alias("label")))


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many ids may be taken with labels above 0, and with the others."""
    return tuple(_known(labels, label).agg(F.count_if(F.expr("label > 0")),
                                             F.count_if(F.expr("label <= 0"))).first())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int,
                    even: bool = False) -> DataFrame:
    """Up to ``size`` documents with their label, the first by a hash of the id.

    Rows without id or label, and the held-out fifth, are never taken; of several labels for one
    id the smallest holds. ``even`` takes up to half of them with labels above 0, and up to half
    with the others. At most ``size`` ids are broadcast.
    """
    known = _known(labels, label)

    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    chosen = first(known, size) if not even else first(
        known.filter("label > 0"), size // 2).union(first(known.filter("label <= 0"), size // 2))
    return docs.join(F.broadcast(chosen), "doc_id")
