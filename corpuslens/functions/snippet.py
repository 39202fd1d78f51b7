"""Highlighted snippets and previews, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import (
    ANY_CASE,
    bind,
    blank,
    escape_regex,
    flatten_breaks,
    split_terms,
)

# The text kept on each side of a hit, and the preview's length and messages.
RADIUS = 120
PREVIEW = 2000
TRUNCATED = "...(truncated)"
UNREADABLE = "(Binary file or cannot read)"


def position(text: Column, term: Column, case_sensitive: Column) -> Column:
    """1-based code point position of a term in a text, 0 where it is absent. Without case the
    text is searched as it is, so that no folding moves the place."""
    literal = escape_regex(term)
    before = F.call_function("regexp_extract", text, F.concat(F.lit("(?ius)^(.*?)"), literal),
                             F.lit(1))
    return F.when(case_sensitive, F.instr(text, term)).when(
        F.regexp_like(text, F.concat(F.lit(ANY_CASE), literal)), F.length(before) + 1).otherwise(0)


def snippet_terms(query: Column, phrase: Column) -> Column:
    """What to look for and highlight: the whole query for a phrase, else its words."""
    return F.when(phrase, F.array(query)).otherwise(split_terms(query))


def anchor(cleaned: Column, terms: Column, case_sensitive: Column) -> Column:
    """Position of the first term, in query order, that occurs at all; null if none does."""
    places = F.transform(terms, lambda t: position(cleaned, t, case_sensitive))
    return F.get(F.filter(places, lambda p: p > 0), F.lit(0))


def window(cleaned: Column, at: Column, query: Column) -> Column:
    """The text from 120 characters before the hit to 120 after the length of the whole query."""
    start = F.greatest(F.lit(0), at - 1 - RADIUS)
    end = F.least(F.length(cleaned), at - 1 + F.length(query) + RADIUS)
    return F.substring(cleaned, start + 1, end - start)


def highlight(text: Column, terms: Column, case_sensitive: Column) -> Column:
    """Each occurrence of a term in ``**``, inside words too; no terms leave the text as it is."""
    alternatives = F.array_join(F.transform(terms, escape_regex), "|")
    flags = F.when(case_sensitive, F.lit("")).otherwise(F.lit(ANY_CASE))
    return F.when(F.size(terms) == 0, text).otherwise(
        F.regexp_replace(text, F.concat(flags, alternatives), F.lit("**$0**"))
    )


def truncated(cleaned: Column) -> Column:
    return F.substring(cleaned, 1, 2 * RADIUS)


def snippet(text: Column, query: Column, case_sensitive: Column, phrase: Column) -> Column:
    """The snippet of a hit: ``''`` for a blank text, its head where no term occurs literally."""
    def around(cleaned: Column) -> Column:
        return bind(snippet_terms(query, phrase), lambda terms: bind(
            anchor(cleaned, terms, case_sensitive),
            lambda at: F.when(at.isNull(), truncated(cleaned)).otherwise(
                highlight(window(cleaned, at, query), terms, case_sensitive)
            ),
        ))

    return F.when(blank(text), F.lit("")).otherwise(bind(flatten_breaks(text), around))


def preview(text: Column) -> Column:
    """The first 2000 characters of a file, or a message where it could not be read."""
    head = F.when(
        F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit(TRUNCATED))
    ).otherwise(text)
    return F.coalesce(head, F.lit(UNREADABLE))
