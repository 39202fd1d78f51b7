"""License scans: canonical digests of whole texts, looked up among known licence digests.

A text is brought into one canonical form: A-Z in lower case, copyright lines taken out, every run
of other characters than letters and digits one blank, equivalent spellings made one. The digest
of that form is hash-joined with the digests of the known licences. Besides the whole text each of
its lines is a text of its own, which finds one-line notices inside longer documents; their
digests are looked up in a map inside the row, so that no line is ever shuffled.

The known digests come from a fixed list of texts, so their number is bounded by the list, which
is why they are broadcast. All of it is DataFrame functions.

Defined cases: a null text counts as empty; an empty canonical text has a digest and no licence;
texts of any length are read whole; repeated rows and rows that tie stay as they are; columns of
the input stay, and the added ones replace any of the same name. No rows give no rows.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.licence_texts import LICENCES, SPELLINGS
from corpuslens.llm.text import ascii_lower, bind

COPYRIGHT_LINE = (
    r"(?md)^[ \t\r]*(?:[*#/;-]+[ \t]*)?(?:copyright[ \t:,]+(?:\(c\)|\x{A9}|[0-9]{4}|by )"
    r"|\(c\)[ \t]*[0-9]{4}|\x{A9}[ \t]*[0-9]{4}|all rights reserved)[^\n]*")
COPYRIGHT_MARKS = ("copyright", "(c)", "\u00a9", "all rights reserved")
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that is not a copyright line and not empty in that form."""
    def bare(low: Column) -> Column:
        marked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in COPYRIGHT_MARKS])
        return F.when(marked, F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low)

    kept = bind(bind(F.coalesce(text, F.lit("")), ascii_lower), bare)
    words = F.regexp_replace(F.replace(kept, F.lit("&"), F.lit(" and ")), NOT_WORD, " ")
    return F.filter(F.transform(F.split(words, "\n"), lambda line: F.trim(line)),
                    lambda line: line != "")


def one_spelling(words: Column) -> Column:
    """Equivalent spellings made one; the text is words with single blanks."""
    either = "|".join(variant for variant, _ in SPELLINGS)

    def replaced(padded: Column) -> Column:
        one = reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")),
                     SPELLINGS, padded)
        return F.when(padded.rlike(f" (?:{either}) "), F.trim(one)).otherwise(F.trim(padded))

    return bind(F.concat(F.lit(" "), words, F.lit(" ")), replaced)


def canonical(text: Column) -> Column:
    return one_spelling(F.array_join(canonical_lines(text), " "))


def known_digests(spark: SparkSession, licences=LICENCES) -> DataFrame:
    """``digest, license`` of the known texts; of several names for one text the first by name."""
    rows = spark.createDataFrame(list(licences), "license string, text string")
    return (rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
            .groupBy("digest").agg(F.min("license").alias("license")))


def scan_licences(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Add ``text_digest``, ``license``, ``notices`` and ``n_notices`` to each row.

    ``license`` is that of the whole text, null if unknown; ``notices`` are the licences that
    single lines name (sorted, once each), ``n_notices`` counts those lines. ``known`` holds
    ``digest, license`` and must be small: it is collected and broadcast.
    """
    added = ["text_digest", "license", "notices", "n_notices"]
    kept = [c for c in docs.columns if c not in added]
    pairs = known.limit(100_001).collect()
    if len(pairs) > 100_000:
        raise ValueError("more than 100,000 known digests")
    names = {r["digest"]: r["license"] for r in pairs}
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in names]).cast("array<string>"),
                              F.array(*[F.lit(v) for v in names.values()]).cast("array<string>"))
    lines = docs.select(*kept, canonical_lines(F.col(text)).alias("lines_"))
    found = F.filter(F.transform("lines_", lambda line: F.try_element_at(
        table, F.sha2(one_spelling(line), 256))), lambda name: name.isNotNull())
    digested = lines.select(
        *kept, F.sha2(one_spelling(F.array_join("lines_", " ")), 256).alias("text_digest"),
        found.alias("found_"))
    lookup = docs.sparkSession.createDataFrame(
        [(r["digest"], r["license"]) for r in pairs], "text_digest string, license string")
    return digested.join(F.broadcast(lookup), "text_digest", "left").select(
        *kept, "text_digest", "license", F.sort_array(F.array_distinct("found_")).alias("notices"),
        F.size("found_").cast("long").alias("n_notices"))


def canonical_sql(text: str) -> tuple[str, str]:
    """The same in DuckDB's words: the list of canonical lines, and a text in one spelling."""
    low = (f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', "
           f"'{string.ascii_lowercase}')")
    line = COPYRIGHT_LINE.replace("(?md)", "(?m)")
    bare = f"regexp_replace({low}, '{line}', '', 'g')"
    words = f"regexp_replace(replace({bare}, '&', ' and '), '{NOT_WORD}', ' ', 'g')"
    lines = (f"list_filter(list_transform(string_split({words}, chr(10)), lambda x: trim(x)), "
             "lambda x: x <> '')")

    def spelled(joined: str) -> str:
        return "trim(" + reduce(lambda t, p: f"replace({t}, ' {p[0]} ', ' {p[1]} ')", SPELLINGS,
                                f"concat(' ', {joined}, ' ')") + ")"

    return lines, spelled
