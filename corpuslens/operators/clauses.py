"""From a table of queries to their clauses and tokens, as column expressions.

A query text is words between white space. In the plain form the upper-case words AND, OR and
NOT join clauses; a clause is MUST unless OR introduces it; OR also demotes the clause before it
to SHOULD, AND promotes it, NOT negates the next one. All other symbols are literal.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import (
    WORD_SPACE,
    bind,
    case_tokens,
    kept,
    lowered,
    small,
    split_terms,
)
from corpuslens.schema import FIELD, FIELD_CASE, QUERIES

MUST, SHOULD, NOT = "must", "should", "not"

# The state while the words of a plain query are read from left to right: the clauses so far, an
# AND or OR still to be used, whether NOT came just before, whether any clause text was seen.
_START = """named_struct(
    'clauses', CAST(array() AS array<struct<word:string,occur:string>>), 'joiner', '',
    'negate', false, 'seen', false, 'error', CAST(NULL AS string))"""
_PLAIN = f"""aggregate(words, {_START}, (s, w) -> CASE
    WHEN s.error IS NOT NULL THEN s
    WHEN w.word = 'NOT' AND s.negate
      OR w.word IN ('AND', 'OR') AND (NOT s.seen OR s.joiner <> '' OR s.negate)
    THEN named_struct('clauses', s.clauses, 'joiner', s.joiner, 'negate', s.negate,
                      'seen', s.seen, 'error', concat('unexpected ', w.word))
    WHEN w.word = 'NOT'
    THEN named_struct('clauses', s.clauses, 'joiner', s.joiner, 'negate', true,
                      'seen', s.seen, 'error', CAST(NULL AS string))
    WHEN w.word IN ('AND', 'OR')
    THEN named_struct('clauses', s.clauses, 'joiner', w.word, 'negate', s.negate,
                      'seen', s.seen, 'error', CAST(NULL AS string))
    ELSE named_struct(
      'clauses', concat(
        CASE WHEN size(s.clauses) = 0 OR s.joiner = '' THEN s.clauses
             ELSE concat(slice(s.clauses, 1, size(s.clauses) - 1), array(named_struct(
               'word', element_at(s.clauses, -1).word,
               'occur', CASE WHEN element_at(s.clauses, -1).occur = 'not' THEN 'not'
                             WHEN s.joiner = 'AND' THEN 'must' ELSE 'should' END))) END,
        CASE WHEN w.has_token THEN array(named_struct('word', w.word,
               'occur', CASE WHEN s.negate THEN 'not' WHEN s.joiner = 'OR' THEN 'should'
                             ELSE 'must' END))
             ELSE array() END),
      'joiner', '', 'negate', false, 'seen', true, 'error', CAST(NULL AS string))
  END)"""
# Struct of clauses and error for each kind. A fuzzy word is lower-cased and not analysed; the
# text of a phrase is one clause, which matches nothing if it has no tokens.
_READ = f"""CASE kind
  WHEN 'phrase' THEN named_struct(
    'clauses', array(named_struct('word', text, 'occur', 'must')), 'error', CAST(NULL AS string))
  WHEN 'fuzzy' THEN named_struct(
    'clauses', transform(words, w -> named_struct('word', w.small, 'occur', 'must')),
    'error', CASE WHEN exists(words, w -> w.word IN ('AND', 'OR', 'NOT'))
                  THEN 'operator in a fuzzy query'
                  WHEN size(words) = 0 THEN 'empty query' END)
  ELSE transform(array({_PLAIN}), s -> named_struct(
    'clauses', s.clauses,
    'error', CASE WHEN s.error IS NOT NULL THEN s.error
                  WHEN s.joiner <> '' OR s.negate THEN 'ends with an operator'
                  WHEN NOT s.seen THEN 'empty query' END))[0]
  END"""


def query_table(spark: SparkSession, queries: Iterable[tuple]) -> DataFrame:
    """Rows ``(query_id, text, case_sensitive, fuzzy, phrase, k)`` as a table."""
    columns = zip(*queries, strict=True)
    table = pa.table({name: pa.array(list(values)) for name, values
                      in zip(QUERIES.names, columns, strict=True)})
    return spark.createDataFrame(table, QUERIES)


def read_queries(queries: DataFrame) -> DataFrame:
    """Add ``kind`` (phrase wins over fuzzy), ``field``, ``clauses`` and ``error``."""
    text = F.col("text")
    words = F.when(F.col("fuzzy"), split_terms(text)).otherwise(split_terms(text, WORD_SPACE))
    with_words = queries.select(
        "*",
        F.expr("CASE WHEN phrase THEN 'phrase' WHEN fuzzy THEN 'fuzzy' ELSE 'plain' END AS kind"),
        F.expr(f"CASE WHEN case_sensitive THEN '{FIELD_CASE}' ELSE '{FIELD}' END AS field"),
        F.transform(words, lambda w: F.struct(
            w.alias("word"), small(w).alias("small"), F.exists(case_tokens(w), kept).alias("has_token"))).alias("words"))
    return (with_words.select("*", F.expr(_READ).alias("read")).drop("words")
            .select("*", "read.clauses", "read.error").drop("read"))


def query_errors(queries: DataFrame) -> DataFrame:
    """``query_id, error`` of the queries that cannot be run; a batch runs all others."""
    return read_queries(queries).filter("error IS NOT NULL").select("query_id", "error")


def query_clauses(queries: DataFrame) -> DataFrame:
    """One row per clause: ``query_id, k, kind, field, n_must, n_counted, slot, occur, word, tokens``.

    ``n_counted`` are the clauses not negated. ``tokens`` are ``(term, offset)`` as the field's
    analyser gives them; offsets keep the places of over-long tokens.
    """
    tokens = bind(case_tokens(F.col("clause.word")), lambda t: F.filter(
        F.transform(F.when(F.col("case_sensitive"), t).otherwise(lowered(t)),
                    lambda term, i: F.struct(term.alias("term"), i.alias("offset"))),
        lambda p: kept(p["term"])))
    return (
        read_queries(queries).filter("error IS NULL")
        .select("query_id", "k", "kind", "field", "case_sensitive",
                F.expr("size(filter(clauses, c -> c.occur = 'must')) AS n_must"),
                F.expr("size(filter(clauses, c -> c.occur <> 'not')) AS n_counted"),
                F.posexplode("clauses").alias("slot", "clause"))
        .select("query_id", "k", "kind", "field", "n_must", "n_counted", "slot",
                "clause.word", "clause.occur", tokens.alias("tokens"))
    )
