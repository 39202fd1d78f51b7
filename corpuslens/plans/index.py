"""The full-text index: built from documents, kept as bucketed Parquet tables.

Documents and postings are bucketed by ``doc_id``. All postings of a document are then in one
bucket, so a search matches, intersects and scores without a shuffle of postings; only each
bucket's best hits move. Inside a bucket postings are sorted by field and term, so that a term's
rows are a short range of row groups and pages. Building shuffles the documents once and never
the postings, which are larger.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.paths import document_id
from corpuslens.operators.bounded import SMALL_ROWS
from corpuslens.operators.postings import POSTINGS, one_per_path, postings, vocabulary
from corpuslens.operators.versions import chain, latest, publish, version_path

DOCS = "doc_id bigint, path string, text string, mtime_us bigint"
VOCAB = "field string, term string, df bigint, cf bigint, top double"
REMOVED = "doc_id bigint, layer int"
SORTED_BY = {
    "docs": ("doc_id",),
    "postings": ("field", "term", "doc_id"),
}
# A bucket of so much text has about 3 million postings, 400 MB as rows, which a task sorts in
# memory. Less text has enough buckets to keep the session's tasks busy, but none for less than the
# last figure; more than the second figure's buckets are made only where one would outgrow the third.
TEXT_PER_BUCKET = 16 << 20
MANY_BUCKETS = 4096
MOST_TEXT_PER_BUCKET = 256 << 20
LEAST_TEXT_PER_BUCKET = 1 << 20


@dataclass(frozen=True)
class Index:
    """An index as tables.

    ``layers`` are postings tables; each document has its postings in one of them. With
    ``signed``, ``vocab`` may hold several rows per term, negative ones for removed documents,
    and their sum counts. ``co_located`` says that the postings of a document are in one
    partition, hashed or bucketed by ``doc_id``.
    """

    docs: DataFrame
    layers: tuple[DataFrame, ...]
    vocab: DataFrame
    signed: bool = False
    co_located: bool = False
    version: int | None = None
    _n_docs: list = field(default_factory=list, compare=False, repr=False)

    @property
    def n_docs(self) -> int:
        """How many documents are live; counted at most once."""
        if not self._n_docs:
            self._n_docs.append(self.docs.count())
        return self._n_docs[0]

    @property
    def postings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.layers)

    def terms(self, entries: DataFrame | None = None) -> DataFrame:
        """``field, term, df, cf`` with one row per term in use; of some vocabulary rows only."""
        return self.bounds(self.vocab if entries is None else entries).drop("top")

    def bounds(self, entries: DataFrame) -> DataFrame:
        """``terms`` with ``top``: no live document has more of the term in its score, before the
        weight. It stays when the document goes that had so much; 1 where it is not known, as
        ``sqrt(tf / len)`` is never more."""
        top = F.when(F.col("df") > 0, F.coalesce("top", F.lit(1.0))).alias("top")
        rows = entries.select("field", "term", "df", "cf", top)
        if not self.signed:
            return rows
        return (rows.groupBy("field", "term")
                .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("top").alias("top"))
                .filter("df > 0"))


def as_documents(docs: DataFrame) -> DataFrame:
    """The four columns of a document; one without an id gets the hash of its path."""
    key = F.col("doc_id") if "doc_id" in docs.columns else document_id(F.col("path"))
    return docs.select(key.cast("bigint").alias("doc_id"), "path", "text", "mtime_us")


def spread(docs: DataFrame) -> DataFrame:
    """Documents hashed by id over the session's shuffle partitions; few large row groups would
    otherwise leave the tokenizer to few tasks."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(tasks, "doc_id")


def build_index(docs: DataFrame) -> Index:
    """The index of ``(doc_id, path, text, mtime_us)``, lazily; of several rows of one path the
    newest counts."""
    documents = spread(as_documents(one_per_path(docs)))
    entries = postings(documents)
    return Index(documents, (entries,), vocabulary(entries))


def _table_name(location: str, buckets: int, part: str) -> str:
    """A catalogue entry left by another layout of the same place has another name."""
    return "corpuslens_" + hashlib.md5(f"{part} {buckets} {location}".encode()).hexdigest()


def _write_bucketed(df: DataFrame, location: str, buckets: int, part: str) -> DataFrame:
    name = _table_name(location, buckets, part)
    (df.write.format("parquet").mode("overwrite").option("path", location)
     .bucketBy(buckets, "doc_id").sortBy(*SORTED_BY[part]).saveAsTable(name))
    return df.sparkSession.table(name)


def _read_bucketed(spark: SparkSession, location: str, buckets: int, part: str,
                   columns: str) -> DataFrame:
    name = _table_name(location, buckets, part)
    location = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"""
        CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{location}'
        CLUSTERED BY (doc_id) SORTED BY ({', '.join(SORTED_BY[part])}) INTO {buckets} BUCKETS""")
    return spark.table(name)


def _write_vocab(entries: DataFrame, location: str) -> None:
    """Ordered by term over all files, so that a look-up reads few row groups."""
    (entries.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
     .write.mode("overwrite").parquet(location))


def refuse_shared_ids(documents: DataFrame) -> None:
    """Two live documents with one id would merge their postings; on a bucketed table this
    check needs no shuffle."""
    shared = documents.groupBy("doc_id").count().filter("count > 1").limit(1).collect()
    if shared:
        raise ValueError(f"doc_id {shared[0]['doc_id']} belongs to more than one document")


def write_layer(spark: SparkSession, root: str, version: int, buckets: int,
                docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write documents and their postings; returns both tables as written."""
    ready = as_documents(docs).repartition(buckets, "doc_id")
    location = version_path(root, version, "docs")
    saved = _write_bucketed(ready, location, buckets, "docs")
    refuse_shared_ids(saved)
    entries = _write_bucketed(postings(texts_by_bucket(spark, location, buckets)),
                              version_path(root, version, "postings"), buckets, "postings")
    return saved, entries


def texts_by_bucket(spark: SparkSession, location: str, buckets: int) -> DataFrame:
    """Stored documents, each bucket in a task of its own and in the order of the ids. A scan of
    the table would pack many buckets into a task, which then sorts all of their postings."""
    stored = spark.read.schema(DOCS).parquet(location).select("doc_id", "text")
    return stored.repartition(buckets, "doc_id").sortWithinPartitions("doc_id")


def bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets for so many bytes of text; whole rounds of tasks, as buckets are equal."""
    tasks = spark.sparkContext.defaultParallelism
    whole = tasks * max(1, math.ceil(size / TEXT_PER_BUCKET / tasks))
    few = min(whole, max(tasks, MANY_BUCKETS), math.ceil(size / LEAST_TEXT_PER_BUCKET))
    return max(1, few, math.ceil(size / MOST_TEXT_PER_BUCKET))


def text_size(docs: DataFrame) -> int:
    """Bytes of text, from the files' sizes where these are known."""
    size = F.col("size") if "size" in docs.columns else F.octet_length("text")
    return docs.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0


def save_index(spark: SparkSession, docs: DataFrame, root: str,
               buckets: int | None = None) -> Index:
    """Build the index of ``docs`` under ``root`` as a new version without a past (a rebuild).

    ``root`` must lie outside the corpus. Of several rows of one path the newest counts. The
    number of buckets follows the bytes of text, unless it is given.
    """
    buckets = buckets or bucket_count(spark, text_size(docs))
    entry = latest(spark, root)
    version = 1 if entry is None else entry["version"] + 1
    saved, entries = write_layer(spark, root, version, buckets, one_per_path(docs))
    _write_vocab(vocabulary(entries), version_path(root, version, "vocab"))
    publish(spark, root, version=version, buckets=buckets, n_docs=saved.count(), n_removed=0)
    return open_index(spark, root)


def index_exists(spark: SparkSession, root: str | None) -> bool:
    return bool(root) and latest(spark, root) is not None


def removals(spark: SparkSession, root: str, layers: list[dict]) -> DataFrame | None:
    """``doc_id, layer``: the ids that went, each with the layer that removed it. All layers'
    rows are one table; a refresh adds a file to it."""
    paths = [version_path(root, layer["version"], "removed") for layer in layers[1:]]
    return spark.read.schema(REMOVED).parquet(*paths) if paths else None


def open_index(spark: SparkSession, root: str) -> Index:
    """The live version: its base and the layers that refreshes put on it."""
    entry = latest(spark, root)
    if entry is None:
        raise ValueError(f"no index at {root}")
    layers = chain(spark, root, entry)
    gone = removals(spark, root, layers)
    if gone is not None and (entry["n_removed"] or 0) <= SMALL_ROWS:
        gone = F.broadcast(gone)

    def live(place: int, part: str, columns: str) -> DataFrame:
        """A layer's rows without those that a later layer removed: one join, by broadcast or
        with the ids shuffled to the layer's buckets."""
        layer = layers[place]
        location = version_path(root, layer["version"], part)
        rows = _read_bucketed(spark, location, layer["buckets"], part, columns)
        if place == len(layers) - 1:
            return rows
        left, right = rows.alias("rows_"), gone.alias("gone_")
        later = (F.col("rows_.doc_id") == F.col("gone_.doc_id")) & (
            F.col("gone_.layer") > layer["version"])
        return left.join(right, later, "left_anti").select(*rows.columns)

    docs = reduce(DataFrame.unionByName, [live(i, "docs", DOCS) for i in range(len(layers))])
    postings_layers = tuple(live(i, "postings", POSTINGS) for i in range(len(layers)))
    vocab = spark.read.schema(VOCAB).parquet(
        *[version_path(root, layer["version"], "vocab") for layer in layers])
    index = Index(docs, postings_layers, vocab, signed=len(layers) > 1, co_located=True,
                  version=entry["version"])
    index._n_docs.append(entry["n_docs"])
    return index
