"""Incremental refresh: find new and changed files, index only those, drop what they replace."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.bounded import among, checkpointed, hinted, settle
from corpuslens.operators.filters import indexable_metadata, is_binary
from corpuslens.operators.postings import one_per_path, postings, vocabulary
from corpuslens.operators.versions import latest, publish, version_path
from corpuslens.plans.index import (
    DOCS,
    Index,
    _write_vocab,
    as_documents,
    bucket_count,
    open_index,
    save_index,
    spread,
    write_layer,
)
from corpuslens.schema import DEFAULT_EXTENSIONS, MAX_FILE_BYTES

Reader = Callable[[DataFrame], DataFrame]


def unchanged(now: Column, before: Column) -> Column:
    """Same modification time; an older time is a change as well."""
    return now == before


FACTS = ["path", "extension", "size", "mtime_us"]


def classify(files: DataFrame, prev_docs: DataFrame, admitted: Column) -> DataFrame:
    """Metadata of the files with ``change_class`` (rejected, new, unchanged, changed) and the
    id indexed before. The join moves no texts."""
    before = prev_docs.select("path", F.col("doc_id").alias("prev_doc_id"),
                              F.col("mtime_us").alias("prev_mtime_us"))
    facts = files.select(*FACTS, *[c for c in ("doc_id",) if c in files.columns])
    change = (F.when(~F.coalesce(admitted, F.lit(False)), "rejected")
              .when(F.col("prev_mtime_us").isNull(), "new")
              .when(unchanged(F.col("mtime_us"), F.col("prev_mtime_us")), "unchanged")
              .otherwise("changed"))
    return facts.join(before, "path", "left").withColumn("change_class", change)


def upsert(prev: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of documents that stay, and the rows of the new ones."""
    stay = prev.join(removed, "doc_id", "left_anti").select(*prev.columns)
    return stay.unionByName(new)


def index_counters(classes: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row ``files_indexed, files_unchanged, files_skipped``.

    Skipped are the rejected files and those that turned out binary when read.
    """
    zero = F.lit(0).cast("bigint")
    by_class = classes.agg(
        zero.alias("indexed"), F.count_if(F.col("change_class") == "unchanged").alias("same"),
        F.count("*").alias("files"))
    taken = indexed.agg(F.count("*").alias("indexed"), zero.alias("same"), zero.alias("files"))
    total = by_class.unionByName(taken).agg(
        F.sum("indexed").alias("i"), F.sum("same").alias("u"), F.sum("files").alias("n"))
    return total.select(F.col("i").alias("files_indexed"), F.col("u").alias("files_unchanged"),
                        (F.col("n") - F.col("i") - F.col("u")).alias("files_skipped"))


@dataclass(frozen=True)
class Refreshed:
    """What a refresh found: the next index, its counters, and the difference."""

    index: Index
    stats: DataFrame
    new_docs: DataFrame
    removed: DataFrame


def _from_table(files: DataFrame) -> Reader:
    """Fetch the texts of due files from the table that has them."""
    def read(due: DataFrame) -> DataFrame:
        return files.select("path", "content", "text").join(due, "path")
    return read


def _indexed(classes: DataFrame, files: DataFrame, read: Reader | None) -> DataFrame:
    """New and changed files, read; binary ones drop out."""
    due = classes.filter(F.col("change_class").isin("new", "changed"))
    return (read or _from_table(files))(due).filter(~is_binary(F.col("content")))


def _removed(prev_docs: DataFrame, classes: DataFrame, indexed: DataFrame,
             prune: bool) -> DataFrame:
    """Ids whose old version goes: replaced ones, and with ``prune`` all that are not to stay."""
    if not prune:
        return (indexed.filter("prev_doc_id IS NOT NULL")
                .select(F.col("prev_doc_id").alias("doc_id")))
    stay = classes.filter(F.col("change_class") == "unchanged").select("path")
    return prev_docs.join(stay, "path", "left_anti").select("doc_id")


def refresh_index(prev: Index, files: DataFrame, read: Reader | None = None,
                  allowed: Iterable[str] = DEFAULT_EXTENSIONS,
                  max_bytes: int = MAX_FILE_BYTES, prune: bool = False) -> Refreshed:
    """The index after a look at ``files``, as a function of both.

    ``files`` has ``path, extension, size, mtime_us`` and either ``content, text`` or a ``read``
    that adds them; only new and changed files are read. Documents whose file is gone, grew too
    long or turned binary stay in the index, unless ``prune`` is set.
    """
    classes = classify(files, prev.docs, indexable_metadata(allowed, max_bytes))
    indexed = _indexed(classes, files, read)
    new_docs = as_documents(indexed)
    removed = _removed(prev.docs, classes, indexed, prune)
    new_entries = postings(spread(new_docs))
    vocab = (prev.vocab.unionByName(vocabulary(new_entries))
             .unionByName(removed_counts(prev, removed)))
    following = Index(upsert(prev.docs, new_docs, removed),
                      (upsert(prev.postings, new_entries, removed),), vocab, signed=True)
    return Refreshed(following, index_counters(classes, indexed), new_docs, removed)


def removed_counts(prev: Index, gone: DataFrame, rows: list[dict] | None = None) -> DataFrame:
    """What the vocabulary loses with the documents ``gone``, as negative counts.

    The stored text of a document says what its postings are, so only the texts of the documents
    that go are cut into terms again, and no posting is read. A few ids (``rows``) prune the
    texts to the buckets and pages that hold them; more meet them bucket by bucket.
    """
    docs = among(prev.docs.select("doc_id", "text"), "doc_id", rows)
    counts = vocabulary(postings(docs.join(hinted(gone, rows), "doc_id", "left_semi")))
    return counts.withColumns({"df": -F.col("df"), "cf": -F.col("cf"),
                               "top": F.lit(None).cast("double")})


def refresh_saved(spark: SparkSession, root: str, files: DataFrame, read: Reader | None = None,
                  allowed: Iterable[str] = DEFAULT_EXTENSIONS, max_bytes: int = MAX_FILE_BYTES,
                  prune: bool = False, buckets: int | None = None) -> tuple[Index, DataFrame]:
    """Refresh the index under ``root`` by a new layer: ``(index, stats)``.

    The layer holds the new documents, their postings, the ids that go and the change in the
    vocabulary; the earlier layers are not rewritten. ``compact`` folds them into one. Where
    nothing is due there is no new layer. Of several files of one path the newest counts. The
    layer's buckets follow the bytes of the due files, unless ``buckets`` is given.
    """
    entry = latest(spark, root)
    files = one_per_path(files)
    admitted = indexable_metadata(allowed, max_bytes)
    if entry is None:
        classes = checkpointed(classify(files, build_empty(spark), admitted))
        index = save_index(spark, _indexed(classes, files, read), root, buckets)
        return index, index_counters(classes, index.docs)
    prev = open_index(spark, root)
    version = entry["version"] + 1
    # One listing decides; the texts are read after it.
    classes = checkpointed(classify(files, prev.docs, admitted))
    due = classes.filter(F.col("change_class").isin("new", "changed")).agg(
        F.count("*").alias("files"), F.sum("size").alias("size")).first()
    if not prune and not due["files"]:
        return prev, index_counters(classes, build_empty(spark))
    buckets = buckets or bucket_count(spark, due["size"] or 0)
    saved, entries = write_layer(spark, root, version, buckets, _indexed(classes, files, read))
    written = classes.join(saved.select("path"), "path", "left_semi")
    place = version_path(root, version, "removed")
    (_removed(prev.docs, classes, written, prune).withColumn("layer", F.lit(version))
     .write.mode("overwrite").parquet(place))
    gone, rows = settle(spark.read.schema("doc_id bigint").parquet(place))
    refuse_reused_ids(prev.docs, gone, rows, saved)
    _write_vocab(vocabulary(entries).unionByName(removed_counts(prev, gone, rows)),
                 version_path(root, version, "vocab"))
    n_new, n_gone = saved.count(), len(rows) if rows is not None else gone.count()
    publish(spark, root, version=version, base=entry["base"], buckets=buckets,
            n_docs=entry["n_docs"] + n_new - n_gone,
            n_removed=entry["n_removed"] + n_gone)
    return open_index(spark, root), index_counters(classes, saved)


def refuse_reused_ids(prev_docs: DataFrame, gone: DataFrame, rows: list[dict] | None,
                      new: DataFrame) -> None:
    """A new document must not take the id of one that stays."""
    known = prev_docs.select("doc_id").join(new.select("doc_id"), "doc_id", "left_semi")
    taken = known.join(hinted(gone, rows), "doc_id", "left_anti").limit(1).collect()
    if taken:
        raise ValueError(f"doc_id {taken[0]['doc_id']} belongs to more than one document")


def build_empty(spark: SparkSession) -> DataFrame:
    """A documents table without rows, for a first refresh."""
    return spark.createDataFrame([], DOCS)


def compact(spark: SparkSession, root: str) -> Index:
    """Fold all layers into a new base, from the documents that are live; its buckets follow
    their bytes."""
    return save_index(spark, open_index(spark, root).docs, root)


__all__ = ["Refreshed", "classify", "compact", "index_counters", "one_per_path",
           "refresh_index", "refresh_saved", "unchanged", "upsert"]
