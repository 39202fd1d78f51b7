"""Words of the vocabulary within two edits of a query word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.distance import osa_distance
from corpuslens.operators.bounded import hinted, settle

# The largest distance, and how many words one query word stands for.
MAX_EDITS = 2
EXPANSIONS = 50
# A swap of neighbours costs two plain edits, so two edits with swaps are at most four without.
PLAIN_EDITS = 2 * MAX_EDITS
# Up to this many query words each vocabulary word is compared with all words of like length.
FEW_WORDS = 64
# Up to this many query words their keys (at most 255 each) are broadcast.
KEYED_WORDS = 2_000
# Longer words are keyed by pieces instead of deletions, of which they have too many.
LONG_WORD = 20
PIECES = PLAIN_EDITS + 1


def boost(distance: Column, word: Column, term: Column) -> Column:
    """1 for the same word, else smaller with the distance and larger with the length."""
    shorter = F.least(F.length(word), F.length(term))
    return F.when(distance == 0, F.lit(1.0)).otherwise(1.0 - distance / shorter)


def deletions(word: Column) -> Column:
    """The word and all it can become by deleting one or two characters."""
    def without(w: Column, i: Column) -> Column:
        return F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))

    def shorter(w: Column) -> Column:
        places = F.when(F.length(w) == 0, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(1), F.length(w)))
        return F.transform(places, lambda i: without(w, i))

    once = F.array_distinct(shorter(word))
    twice = F.flatten(F.transform(once, shorter))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _piece(n: Column, i: int) -> tuple[Column, Column]:
    """Start (1-based) and length of piece ``i`` of a word of length ``n``."""
    start = F.floor(n * i / PIECES).cast("int")
    end = F.floor(n * (i + 1) / PIECES).cast("int")
    return start + 1, end - start


def _key(n: Column, i: int, text: Column) -> Column:
    return F.concat_ws(":", n.cast("string"), F.lit(str(i)), text)


def word_pieces(word: Column) -> Column:
    """A word cut into five: four plain edits leave one piece whole."""
    n = F.length(word)
    return F.array(*[_key(n, i, F.substring(word, *_piece(n, i))) for i in range(PIECES)])


def term_pieces(term: Column) -> Column:
    """The places in a term where a piece of a word of like length may stand."""
    keys = []
    for difference in range(-MAX_EDITS, MAX_EDITS + 1):
        n = F.length(term) + difference
        for i in range(PIECES):
            start, length = _piece(n, i)
            keys += [F.when(start + shift >= 1, _key(n, i, F.substring(term, start + shift, length)))
                     for shift in range(-PLAIN_EDITS, PLAIN_EDITS + 1)]
    return F.array_distinct(F.filter(F.array(*keys), lambda key: key.isNotNull()))


def _near_by_length(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """Few words: an equality join on the length, which differs by two at most."""
    bands = words.withColumn("size", F.explode(F.sequence(
        F.greatest(F.length("word") - MAX_EDITS, F.lit(1)), F.length("word") + MAX_EDITS)))
    return (vocab.withColumn("size", F.length("term"))
            .join(F.broadcast(bands), ["field", "size"])
            .filter(F.levenshtein("term", "word", PLAIN_EDITS) >= 0)
            .drop("size"))


def _near_by_key(vocab: DataFrame, words: DataFrame, rows: list[dict] | None) -> DataFrame:
    """Many words: an equality join on deletions (short words) or pieces (long ones).

    Two words within two edits share a form that each reaches by at most two deletions. Words
    around the limit get keys of both sorts, as lengths differ by up to two.
    """
    def keyed(table: DataFrame, text: str, pieces) -> DataFrame:
        n = F.length(text)
        by_deletion = F.when(n <= LONG_WORD + MAX_EDITS, deletions(F.col(text)))
        by_piece = F.when(n > LONG_WORD - MAX_EDITS, pieces(F.col(text)))
        none = F.array().cast("array<string>")
        return table.withColumn("key", F.explode(F.concat(
            F.transform(F.coalesce(by_deletion, none), lambda k: F.concat(F.lit("d"), k)),
            F.transform(F.coalesce(by_piece, none), lambda k: F.concat(F.lit("p"), k)))))

    keys = keyed(words, "word", word_pieces)
    few = rows if rows is not None and len(rows) <= KEYED_WORDS else None
    pairs = (keyed(vocab.select("field", "term"), "term", term_pieces)
             .join(hinted(keys, few), ["field", "key"])
             .select("field", "term", "word")
             .filter(F.abs(F.length("term") - F.length("word")) <= MAX_EDITS)
             .filter(F.levenshtein("term", "word", PLAIN_EDITS) >= 0)
             .distinct())
    return vocab.join(pairs, ["field", "term"])


def near_terms(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """``field, word, term, distance, df, cf``: every term within two edits of each word.

    Works on the vocabulary alone. ``words`` are distinct ``field, word`` rows; a few are
    compared by length bands, more by shared keys.
    """
    table, rows = settle(words)
    if rows is not None and len(rows) <= FEW_WORDS:
        pairs = _near_by_length(vocab, table)
    else:
        pairs = _near_by_key(vocab, table, rows)
    return (pairs.groupBy("field", "word", "term")
            .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
            .withColumn("distance", osa_distance("word", "term"))
            .filter(F.col("distance") <= MAX_EDITS))


def expansions(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """``field, word, term, boost, df``: the best 50 terms per word, by boost, then by term.

    The window keeps 50 rows per word and task before it shuffles.
    """
    best = W.partitionBy("field", "word").orderBy(F.desc("boost"), "term")
    return (near_terms(vocab, words)
            .withColumn("boost", boost(F.col("distance"), F.col("word"), F.col("term")))
            .filter(F.col("boost") > 0)
            .withColumn("place", F.row_number().over(best))
            .filter(F.col("place") <= EXPANSIONS)
            .select("field", "word", "term", "boost", "df"))
