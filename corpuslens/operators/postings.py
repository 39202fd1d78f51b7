"""The inverted index as tables derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.grouping import PLAIN, sorted_postings
from corpuslens.functions.scoring import length_norm, tf
from corpuslens.functions.text import bind, case_tokens, kept, lowered
from corpuslens.operators.bounded import hinted, settle
from corpuslens.schema import FIELD, FIELD_CASE

POSTINGS = ("field string, term string, doc_id bigint, tf int, positions array<int>, "
            "doc_len int")


def tokenised(docs: DataFrame) -> DataFrame:
    """``doc_id, tokens`` with the case kept; both fields share this one pass over the text."""
    return docs.select("doc_id", case_tokens(F.col("text")).alias("tokens"))


def token_rows(docs: DataFrame, field: str) -> DataFrame:
    """``doc_id, pos, term`` of one field, one row per token."""
    tokens = lowered(F.col("tokens")) if field == FIELD else F.col("tokens")
    return (tokenised(docs).select("doc_id", F.posexplode(tokens).alias("pos", "term"))
            .filter(kept(F.col("term"))))


def postings(docs: DataFrame) -> DataFrame:
    """``field, term, doc_id, tf, positions, doc_len``: one row per term of a document.

    A map over documents, without a shuffle, that groups a chunk of texts at a time
    (``functions/grouping.py``) and hands its rows on in the order of field and term: a sort by
    these has only the chunks' runs to merge. The document length rides along, so that scoring
    needs no join to fetch it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), bind(
        F.rlike(text, F.lit(rf"\A[{PLAIN}]*\z")), lambda plain: bind(
            F.when(~plain, case_tokens(text)), lambda tokens: F.struct(
                F.when(plain, text).alias("text"), tokens.alias("tokens"),
                lowered(tokens).alias("small")))).alias("row"))
    return rows.mapInArrow(sorted_postings, POSTINGS)


def vocabulary(entries: DataFrame) -> DataFrame:
    """``field, term, df, cf, top``; counts combine before the shuffle, so frequent terms are no
    skew. ``top`` is the most that a document has of the term in its score, before the weight."""
    return entries.groupBy("field", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"),
        F.max(tf(F.col("tf")) * length_norm(F.col("doc_len"))).alias("top"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """``field, doc_id, len``: tokens of a document; documents without tokens have no row."""
    lengths = tokenised(docs).select("doc_id", F.size(F.filter("tokens", kept)).alias("len"))
    return (lengths.filter("len > 0")
            .select(F.explode(F.array(F.lit(FIELD), F.lit(FIELD_CASE))).alias("field"),
                    "doc_id", "len"))


def latest_per_path(docs: DataFrame) -> DataFrame:
    """One version per path: the newest, then the highest id (without ids, the highest hash of
    the text). The window keeps one row per path and task before it shuffles."""
    tie = ("doc_id" if "doc_id" in docs.columns else
           F.xxhash64("text") if "text" in docs.columns else F.lit(0))
    newest = W.partitionBy("path").orderBy(F.desc("mtime_us"), F.desc(tie))
    return (docs.withColumn("_row", F.row_number().over(newest))
            .filter(F.col("_row") == 1).drop("_row"))


def one_per_path(docs: DataFrame) -> DataFrame:
    """The newest version of each path. Paths are counted first; only rows of those that come
    several times are shuffled with what they hold."""
    several, rows = settle(docs.groupBy("path").agg(F.count("*").alias("n"))
                           .filter("n > 1").select("path"))
    if rows is not None and not rows:
        return docs
    several = hinted(several, rows)
    once = docs.join(several, "path", "left_anti").select(*docs.columns)
    doubled = docs.join(several, "path", "left_semi").select(*docs.columns)
    return once.unionByName(latest_per_path(doubled))
