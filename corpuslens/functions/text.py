"""Column functions over text: tokens, lines, decoding, escaping."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest token kept, and the classes of the Unicode word-break rules, in Java
# regular expression syntax: what is a word of its own, runs of Katakana, and what joins two
# letters, two digits or either.
MAX_TOKEN = 255
SINGLE = r"\p{IsHan}\p{IsHiragana}"
KATAKANA = r"\p{IsKatakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}"
MID_BOTH = r".\x{27}\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
MID_LETTER = r":\x{B7}\x{387}\x{55F}\x{5F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}"
MID_NUMBER = (r",;\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}"
              r"\x{FE54}\x{FF0C}\x{FF1B}")
# Letters, digits, marks and underscores; a run of Katakana; what stands between two of the first.
# Cheap tests come first, as looking up a character's script is slow.
EAST_ASIAN = r"(?![\x00-\x{2E7F}])"
ALNUM = rf"[A-Za-z0-9_[\p{{L}}\p{{M}}\p{{Nd}}&&[^{SINGLE}{KATAKANA}]]]++"
KANA = rf"{EAST_ASIAN}[{KATAKANA}][{KATAKANA}\p{{M}}]*+"
JOINER = (rf"(?=[{MID_BOTH}{MID_LETTER}{MID_NUMBER}\x{{22}}])"
          rf"(?:(?<=[\p{{L}}\p{{M}}])[{MID_BOTH}{MID_LETTER}](?=\p{{L}})"
          rf"|(?<=\p{{Nd}})[{MID_BOTH}{MID_NUMBER}](?=\p{{Nd}})"
          r"|(?<=\p{IsHebrew})\x{22}(?=\p{IsHebrew}))")
# The matcher's stack grows with the parts of a word, so they are bounded: a word with more is too
# long to be kept, and the rest of it comes as words that begin with a joiner. A Hebrew letter may
# be followed by a quote.
MORE = (rf"(?:{JOINER}{ALNUM}|(?=_){ALNUM}|{EAST_ASIAN}(?<=_){KANA}){{0,{MAX_TOKEN + 1}}}"
        r"(?:\x{27}(?<=\p{IsHebrew}\x{27}))?")
TOKEN = (rf"{ALNUM}(?:(?=\s)|{MORE})|{EAST_ASIAN}[{SINGLE}]\p{{M}}*+|{KANA}{MORE}"
         rf"|{JOINER}{ALNUM}{MORE}")
JOINERS = re.sub(r"\\x\{(\w+)\}", lambda code: chr(int(code[1], 16)),
                 MID_BOTH + MID_LETTER + MID_NUMBER + r"\x{22}")
LONG = rf"\S{{{MAX_TOKEN + 1}}}"
# The white space that splits a query.
TERM_SPACE = r"[ \t\r\n]+"
WORD_SPACE = r"[ \t\r\n\x{3000}]+"

POSTINGS_OF_DOC = "array<struct<term:string,positions:array<int>>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    A lambda variable cannot be inlined by the optimizer, unlike a column of a child projection.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def case_tokens(text: Column) -> Column:
    """Tokens of a text with their case kept, in order; an over-long token still holds its place."""
    whole = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0))
    rest = F.filter(found, lambda word: ~F.contains(F.lit(JOINERS), F.substring(word, 1, 1)))
    return F.when(F.rlike(whole, F.lit(LONG)), rest).otherwise(found)


def lower_tokens(text: Column) -> Column:
    """Tokens of a text, lower-cased."""
    return lowered(case_tokens(text))


def small(token: Column) -> Column:
    """Each code point in lower case by itself. Lower-casing a whole text would make a last sigma
    another letter, and the dotted capital I two letters."""
    return F.lower(F.replace(F.replace(token, F.lit("\u03a3"), F.lit("\u03c3")),
                             F.lit("\u0130"), F.lit("i")))


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, small)


def kept(token: Column) -> Column:
    """False for a token that is too long to be indexed."""
    return F.length(token) <= MAX_TOKEN


def _runs(rows: Column, positions: Callable[[Column, Column], Column]) -> Column:
    """One group for each run of sorted rows with one term; ``positions(start, size)`` are its."""
    n = F.size(rows)

    def term_at(i: Column) -> Column:
        return F.get(rows, i)["term"]

    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: ~term_at(i - 1).eqNullSafe(term_at(i)),
    )
    groups = bind(starts, lambda s: F.transform(s, lambda start, j: F.struct(
        term_at(start).alias("term"),
        positions(start, F.coalesce(F.get(s, j + 1), n) - start).alias("positions"),
    )))
    return F.when(n == 0, F.array().cast(POSTINGS_OF_DOC)).otherwise(groups)


def postings_of_doc(tokens: Column) -> Column:
    """Group one document's tokens by term, with ascending positions, inside the row.

    Sorting (term, position) pairs puts each term's positions next to each other; every place
    where the term changes starts a group. The work is O(n log n) in the length of the document
    and needs no shuffle, since a document is one row.
    """
    pairs = F.filter(
        F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))),
        lambda p: kept(p["term"]),
    )
    return bind(F.sort_array(pairs), lambda rows: _runs(rows, lambda start, size: F.transform(
        F.slice(rows, start + 1, size), lambda p: p["pos"])))


def folded_postings(groups: Column) -> Column:
    """The groups of a document's tokens, merged where their terms are one in lower case. Only
    distinct terms are lower-cased and sorted, not the tokens once more."""
    small_ones = F.transform(groups, lambda g: F.struct(
        small(g["term"]).alias("term"), g["positions"].alias("positions")))

    def merged(rows: Column) -> Column:
        def positions(start: Column, size: Column) -> Column:
            several = F.transform(F.slice(rows, start + 1, size), lambda g: g["positions"])
            return F.when(size == 1, F.get(rows, start)["positions"]).otherwise(
                F.sort_array(F.flatten(several)))
        return _runs(rows, positions)

    return bind(F.sort_array(small_ones), merged)


def lines(text: Column) -> Column:
    """Lines of a text: CR, LF and CR LF end a line; a last empty line does not count."""
    parts = F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\r|\\n")
    return bind(parts, lambda p: F.when(
        F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)
    ).otherwise(p))


def split_terms(text: Column, space: str = TERM_SPACE) -> Column:
    """The words of a query between white space, empty ones dropped."""
    return F.filter(F.split(text, space), lambda w: w != "")


def flatten_breaks(text: Column) -> Column:
    """Each CR and each LF becomes one blank."""
    return F.translate(text, "\r\n", "  ")


def _swapped(digits: Column, width: int) -> Column:
    """Hexadecimal units of ``width`` bytes with their bytes turned round."""
    groups = "".join("(..)" for _ in range(width))
    return F.regexp_replace(digits, groups, "".join(f"${i}" for i in range(width, 0, -1)))


def _utf16(digits: Column) -> Column:
    """Text of UTF-16 units, big end first; an unpaired surrogate or a cut unit is replaced."""
    units = F.regexp_replace(digits, "(....)", "$1 ")
    units = F.regexp_replace(units, "D[89AB].. (?!D[C-F])", "FFFD ")
    units = F.regexp_replace(units, "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    units = F.regexp_replace(units, "(?<= |^)..?.?$", "FFFD")
    return F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-16BE")


def _utf32(digits: Column) -> Column:
    """Text of UTF-32 units, big end first; what is no code point is replaced."""
    units = F.regexp_replace(digits, "(.{8})", "$1 ")
    units = F.regexp_replace(
        units, "(?:0000D[89A-F]..|001[1-9A-F]....|00[2-9A-F].....|(?!00).{8}) ", "0000FFFD ")
    units = F.regexp_replace(units, "(?<= |^).{1,7}$", "0000FFFD")
    return F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-32")


# Byte order marks in hexadecimal digits, longer ones first.
UTF32_LITTLE, UTF32_BIG, UTF16_LITTLE, UTF16_BIG = "FFFE0000", "0000FEFF", "FFFE", "FEFF"


def file_text(content: Column) -> Column:
    """Text of raw bytes: in the encoding that a byte order mark names, else UTF-8; malformed
    bytes are replaced and the mark is dropped."""
    mark = F.hex(F.substring(content, 1, 4))

    def rest(width: int) -> Column:
        return F.hex(F.substring(content, width + 1, 2 ** 31 - 1))

    return (F.when(mark == UTF32_LITTLE, _utf32(_swapped(rest(4), 4)))
            .when(mark == UTF32_BIG, _utf32(rest(4)))
            .when(F.startswith(mark, F.lit(UTF16_LITTLE)), _utf16(_swapped(rest(2), 2)))
            .when(F.startswith(mark, F.lit(UTF16_BIG)), _utf16(rest(2)))
            .otherwise(F.regexp_replace(
                F.make_valid_utf8(content.cast("string")), "^\\x{FEFF}", "")))


SYMBOLS = r"[\\^$.|?*+()\[\]{}#&~\-\s]"
# Letters are compared one by one, each by its own upper and lower case.
ANY_CASE = "(?iu)"


def escape_regex(text: Column) -> Column:
    """A pattern that matches the text literally (each ASCII symbol is escaped by itself)."""
    return F.regexp_replace(text, f"({SYMBOLS})", r"\\$1")


def escaped(text: str) -> str:
    """``escape_regex`` of a text that is known beforehand."""
    return re.sub(f"({SYMBOLS})", r"\\\1", text, flags=re.ASCII)


def blank(text: Column) -> Column:
    """True for a null, empty or white-space-only text."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*\z")
