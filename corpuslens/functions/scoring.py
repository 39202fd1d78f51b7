"""The relevance formula, as column functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: scores are compared and ranked after rounding to this many places.
SCORE_PLACES = 6


def idf(n_docs: Column, df: Column) -> Column:
    """Inverse document frequency; an unknown term has df 0."""
    return 1.0 + F.log(n_docs / (df + 1.0))


def length_norm(doc_len: Column) -> Column:
    """``1/sqrt(len)`` cut to a binary float with two mantissa bits."""
    exact = 1.0 / F.sqrt(doc_len.cast("double"))
    scale = F.pow(F.lit(2.0), F.floor(F.log2(exact)))
    return F.floor(exact / scale * 4.0) / 4.0 * scale


def tf(freq: Column) -> Column:
    return F.sqrt(freq.cast("double"))
