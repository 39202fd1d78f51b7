"""Literal and regular expression matching of names and of lines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import ANY_CASE, escaped, lines


def pattern(term: str, case_sensitive: bool) -> str:
    """The term with flags that give ``. \\d \\w \\b`` and case folding their Unicode meaning."""
    return ("(?dU)" if case_sensitive else "(?iudU)") + term


def check_pattern(spark: SparkSession, term: str) -> None:
    """Raise ``ValueError`` for a malformed pattern, before any file is read."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern(term, False))).collect()
    except Exception as error:
        raise ValueError(f"not a regular expression: {term!r}") from error


def contains(text: Column, term: str, case_sensitive: bool) -> Column:
    """Literal containment; without case, letter by letter, so that lengths never change."""
    if case_sensitive:
        return F.contains(text, F.lit(term))
    return text.rlike(ANY_CASE + escaped(term))


def matches(text: Column, term: str, case_sensitive: bool) -> Column:
    """The pattern occurs somewhere in the text."""
    return text.rlike(pattern(term, case_sensitive))


def name_matches(name: Column, term: str, regex: bool, case_sensitive: bool) -> Column:
    test = matches if regex else contains
    return test(name, term, case_sensitive)


def line_contains(text: Column, term: str, case_sensitive: bool) -> Column:
    """Some line contains the literal.

    A term without a line break lies within one line wherever it occurs, so the whole text is
    searched and never split; a term with a line break cannot occur. An empty text has no line.
    """
    if "\n" in term or "\r" in term:
        return F.lit(False)
    return (F.length(text) > 0) & contains(text, term, case_sensitive)


def line_matches(text: Column, term: str, case_sensitive: bool) -> Column:
    """Some line matches the pattern; lines are tried in order up to the first hit."""
    return F.exists(lines(text), lambda line: matches(line, term, case_sensitive))


def content_matches(text: Column, term: str, regex: bool, case_sensitive: bool) -> Column:
    test = line_matches if regex else line_contains
    return test(text, term, case_sensitive)
