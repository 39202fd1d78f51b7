"""Column functions against answers worked out by hand."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import snippet as S
from corpuslens.functions.distance import osa_distances
from corpuslens.functions.paths import extension, file_name
from corpuslens.functions.scoring import length_norm
from corpuslens.functions.text import (
    case_tokens,
    escape_regex,
    file_text,
    lines,
    lowered,
    postings_of_doc,
    split_terms,
)
from corpuslens.operators import filters, match
from corpuslens.operators.postings import postings
from corpuslens.schema import DEFAULT_EXTENSIONS, SearchOptions


@pytest.mark.parametrize("name, expected", [
    ("a.txt", ".txt"), (".gitignore", ".gitignore"), ("name.", ""), ("noext", ""),
    ("a.tar.gz", ".gz")])
def test_extension(column, name, expected):
    assert column(extension(F.lit(name))) == expected


def test_file_name(column):
    assert column(file_name(F.lit("/a/b.c/d.txt"))) == "d.txt"


@pytest.mark.parametrize("wanted, found", [(["txt"], False), ([".TXT"], True), ([], False)])
def test_extension_list_wants_the_dot(column, wanted, found):
    assert column(filters.extension_in(F.lit(".txt"), wanted)) is found


@pytest.mark.parametrize("size, inside", [(9, False), (10, True), (20, True), (21, False)])
def test_size_bounds_are_inclusive(column, size, inside):
    assert column(filters.size_in_range(F.lit(size), 10, 20)) is inside


@pytest.mark.parametrize("content, binary", [
    (b"ab\x00c", True), (b"a" * 511 + b"\x00", True), (b"a" * 512 + b"\x00", False), (b"", False),
    (None, True)])
def test_binary_probe(column, content, binary):
    assert column(filters.is_binary(F.lit(content).cast("binary"))) is binary


@pytest.mark.parametrize("text, expected", [
    ("", []), ("a\n", ["a"]), ("a\r\nb\rc", ["a", "b", "c"]), ("\n", [""]), ("a\n\n", ["a", ""]),
    (None, [])])
def test_lines(column, text, expected):
    assert column(lines(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("text, pattern, regex, hit", [
    ("", "^$", True, False), ("", "", False, False), ("a", "", False, True),
    ("a\nb", "a\nb", False, False), ("a\nb", "^b", True, True), ("a\nb", r"a\s+b", True, False),
    ("x", "X", False, True), ("Straße 9", r"^\w+ \d$", True, True), ("a\n", "^$", True, False)])
def test_line_search(column, text, pattern, regex, hit):
    assert column(match.content_matches(F.lit(text), pattern, regex, False)) is hit


@pytest.mark.parametrize("text, term, hit", [
    ("\u039f\u0394\u039f\u03a3\u0391", "\u039f\u0394\u039f\u03a3", True),
    ("\u03bf\u03b4\u03bf\u03c3\u03b1", "\u039f\u0394\u039f\u03a3", True),
    ("\u03bf\u03b4\u03bf\u03c2", "\u039f\u0394\u039f\u03a3", True), ("a.b", "A.B", True),
    ("axb", "a.b", False), ("a\\E(b[", "A\\e(B[", True), ("x", "", True), ("#- &~", "- &", True),
    ("STRASSE", "stra\u00dfe", False)])
def test_literals_fold_letter_by_letter(column, text, term, hit):
    assert column(match.contains(F.lit(text), term, False)) is hit


def test_tokens_fold_letter_by_letter(column):
    tokens = F.array(F.lit("\u039f\u0394\u039f\u03a3"), F.lit("\u0130X"), F.lit("\u00c9"))
    assert column(lowered(tokens)) == ["\u03bf\u03b4\u03bf\u03c3", "ix", "\u00e9"]


def test_snippet_of_a_hit_after_letters_that_grow(column):
    text = "\u0130" * 130 + "hit" + "y" * 200
    found = column(S.snippet(F.lit(text), F.lit("HIT"), F.lit(False), F.lit(False)))
    assert found == "\u0130" * 120 + "**hit**" + "y" * 120
    assert column(S.position(F.lit("\U0001f600 a(b"), F.lit("A("), F.lit(False))) == 3
    assert column(S.position(F.lit("a\nb"), F.lit("B"), F.lit(False))) == 3


SAMPLE = "A\u00e9 \u65e5\U0001f600z"


@pytest.mark.parametrize("content, text", [
    (b"\xff\xfe" + SAMPLE.encode("utf-16-le"), SAMPLE),
    (b"\xfe\xff" + SAMPLE.encode("utf-16-be"), SAMPLE),
    (b"\xff\xfe\x00\x00" + SAMPLE.encode("utf-32-le"), SAMPLE),
    (b"\x00\x00\xfe\xff" + SAMPLE.encode("utf-32-be"), SAMPLE),
    (b"\xef\xbb\xbf" + SAMPLE.encode(), SAMPLE), (SAMPLE.encode(), SAMPLE),
    (b"\xff\xfe", ""), (b"\xfe\xff", ""), (b"\xff\xfe\x00\x00", ""), (b"", ""), (None, None),
    (b"\xff\xfeA\x00B", "A\ufffd"), (b"\xfe\xff\x00A\xd8\x00\x00B", "A\ufffdB"),
    (b"\xfe\xff\xdc\x00\xdc\x00\x00B", "\ufffd\ufffdB"),
    (b"\xfe\xff\xd8\x3d\xde\x00\xde\x00", "\U0001f600\ufffd"),
    (b"\x00\x00\xfe\xff\x00\x11\x00\x00\x00\x00\x00A\x00", "\ufffdA\ufffd"),
    (b"\xff\xfe\x00\x00\x00\xd8\x00\x00A\x00\x00\x00", "\ufffdA"),
    (b"a\xffb", "a\ufffdb")])
def test_decoding_by_the_mark(column, content, text):
    assert column(file_text(F.lit(content).cast("binary"))) == text


def test_malformed_pattern_is_refused(spark):
    match.check_pattern(spark, r"a(b)?")
    with pytest.raises(ValueError):
        match.check_pattern(spark, "a(")


def test_tokens_of_the_sample_sentence(column):
    text = ("Can't foo-bar foo_bar 3.14 1,000 a1.b2 www.x.com x@y.de üÄß. 日本 "
            "e.g. a.b.c")
    assert column(case_tokens(F.lit(text))) == [
        "Can't", "foo", "bar", "foo_bar", "3.14", "1,000", "a1", "b2", "www.x.com", "x", "y.de",
        "üÄß", "日", "本", "e.g", "a.b.c"]


def test_long_token_leaves_a_gap(spark):
    docs = spark.createDataFrame([(1, f"{'a' * 255} {'b' * 256} c")], "doc_id int, text string")
    rows = postings(docs).filter("field = 'content'").collect()
    assert {(r["term"], tuple(r["positions"]), r["doc_len"]) for r in rows} == {
        ("a" * 255, (0,), 2), ("c", (2,), 2)}


def test_postings_of_one_row_equal_a_plain_grouping(spark):
    random.seed(3)
    texts = [[random.choice("abcde") * random.randint(1, 2) for _ in range(n)]
             for n in (0, 1, 2, 30, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    for row in df.select("id", postings_of_doc(F.col("tokens")).alias("p")).collect():
        expected = {}
        for at, token in enumerate(texts[row["id"]]):
            expected.setdefault(token, []).append(at)
        assert [(p["term"], p["positions"]) for p in row["p"]] == sorted(expected.items())


@pytest.mark.parametrize("raw, text", [
    (b"\xef\xbb\xbfhi", "hi"), (b"a\xffb", "a�b"), (b"", ""), ("wörld".encode(), "wörld")])
def test_decoding(column, raw, text):
    assert column(file_text(F.lit(raw))) == text


@pytest.mark.parametrize("length, norm", [
    (1, 1.0), (2, 0.625), (3, 0.5), (4, 0.5), (5, 0.4375), (10, 0.3125), (100, 0.09375),
    (1000, 0.03125), (10000, 0.009765625)])
def test_length_norm(column, length, norm):
    assert column(length_norm(F.lit(length))) == norm


SNIPPETS = [
    ("a Cat concat", "cat", False, "a **Cat** con**cat**"),
    ("one\r\ntwo", "two", False, "one  **two**"),
    ("b a", "a b", False, "**b** **a**"),
    ("x" * 300, "q", False, "x" * 240),
    (" \n\t ", "q", False, ""),
    (None, "q", False, ""),
    ("x" * 200 + "hit" + "y" * 200, "hit", False, "x" * 120 + "**hit**" + "y" * 120),
    ("x" * 200 + "hit" + "y" * 200, "zz hit", False, "x" * 120 + "**hit**" + "y" * 123),
    ("x😀 Straße", "stra", False, "x😀 **Stra**ße"),
    ("go (the end) \\E now", "(the \\E", False, "go **(the** end) **\\E** now"),
    ("one two one", "two one", True, "one **two one**"),
]


@pytest.mark.parametrize("text, query, phrase, expected", SNIPPETS)
def test_snippet(column, text, query, phrase, expected):
    assert column(S.snippet(F.lit(text).cast("string"), F.lit(query), F.lit(False),
                            F.lit(phrase))) == expected


def test_snippet_keeps_case_when_asked(column):
    assert column(S.snippet(F.lit("The the"), F.lit("the"), F.lit(True), F.lit(False))) == \
        "The **the**"


def test_escaped_text_matches_itself(column):
    text = r"a.b*c[d]{e}(f)|g^h$i?j+k\E l#m-n&&o~"
    assert column(F.rlike(F.lit(text), F.concat(F.lit("^"), escape_regex(F.lit(text)), F.lit("$"))))


def test_preview(column):
    assert column(S.preview(F.lit("a" * 2001))) == "a" * 2000 + "...(truncated)"
    assert column(S.preview(F.lit("a" * 2000))) == "a" * 2000
    assert column(S.preview(F.lit(None).cast("string"))) == "(Binary file or cannot read)"


def test_term_split(column):
    assert column(split_terms(F.lit(" a\tb\r\n c "))) == ["a", "b", "c"]
    assert column(split_terms(F.lit("  "))) == []


def _osa(a, b):
    table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1,
                          table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
    return table[len(a), len(b)]


def test_batched_distance_equals_the_textbook():
    random.seed(5)
    words = ["".join(random.choices("abcü", k=random.randint(0, 9))) for _ in range(400)]
    pairs = list(zip(words[::2], words[1::2])) + [
        ("form", "from"), ("ca", "abc"), ("ab", "cd"), ("chtung", "chtüng"), ("", "ab")]
    left, right = (pd.Series(side) for side in zip(*pairs))
    assert osa_distances(left, right).tolist() == [_osa(a, b) for a, b in pairs]


def test_default_options():
    options = SearchOptions()
    assert not (options.search_content or options.use_regex or options.case_sensitive
                or options.exact_phrase or options.fuzzy_search)
    assert options.max_size == 25 * 1024 * 1024 and options.min_size == 0
    assert SearchOptions(content_search_mode="nonsense").mode() == "auto"
    assert SearchOptions(content_search_mode="INDEX").mode() == "index"
    assert len(DEFAULT_EXTENSIONS) == 36


@pytest.mark.parametrize("text, words", [
    ("\u30ab\u30bf\u30ab\u30ca abc\u30ab\u30ca", ["\u30ab\u30bf\u30ab\u30ca", "abc",
                                                     "\u30ab\u30ca"]),
    ("\u30ab_a_\u30ab\u30fc", ["\u30ab_a_\u30ab\u30fc"]),
    ("\u65e5\u3099\u672c \u304b\u304d", ["\u65e5\u3099", "\u672c", "\u304b", "\u304d"]),
    ("\uff11\uff0e\uff15 \uff41\uff1a\uff42 3\uff0c4 a\uff0cb", [
        "\uff11\uff0e\uff15", "\uff41\uff1a\uff42", "3\uff0c4", "a", "b"]),
    ("\u05e6\u05d4\"\u05dc \u05d2' ab\"c d'", ["\u05e6\u05d4\"\u05dc", "\u05d2'", "ab",
                                                 "c", "d"]),
    ("a..b .c. 1.a 1,2.3 a_.b ___ 'x'", ["a", "b", "c", "1", "a", "1,2.3", "a_", "b", "___", "x"]),
])
def test_word_breaks(column, text, words):
    assert column(case_tokens(F.lit(text))) == words


@pytest.mark.parametrize("part", ["a.", "_a", "1,", "a.b_", "x", "\u05d0\""])
@pytest.mark.parametrize("times", [90, 130, 300, 5000, 200_000])
def test_words_of_many_parts_are_one(column, part, times):
    """The matcher's stack stays bounded, and an over-long word holds one place."""
    found = column(case_tokens(F.lit(f"so {part * times} on")))
    assert len(found) == 3 and found[0] == "so" and found[2] == "on"
    if len(part) * times <= 255:
        assert found[1] == (part * times).rstrip('.,"')
    if len(part) * times > 512:
        assert len(found[1]) > 255


def test_folded_postings_equal_those_of_lowered_tokens(column):
    from corpuslens.functions.text import folded_postings, lowered, postings_of_doc
    random.seed(4)
    for size in (0, 1, 5, 300):
        words = random.choices(["Foo", "foo", "FOO", "bar", "Bar", "\u0130x", "ix", "x" * 300],
                               k=size)
        tokens = F.array(*[F.lit(w) for w in words]).cast("array<string>")
        assert column(folded_postings(postings_of_doc(tokens))) == (
            column(postings_of_doc(lowered(tokens))))


def test_grouping_by_chunks_equals_grouping_in_rows(spark, monkeypatch):
    """Every plain character between letters, digits and blanks, other scripts, long words, chunks
    of one document, rows without an id or text, and equal ids."""
    from corpuslens.functions.text import case_tokens, folded_postings, kept, postings_of_doc

    around = "a{0}b 1{0}2 a{0}1 1{0}B _{0}c {0}{0} x{0} Z_{0}9"
    texts = [(code, around.format(chr(code)))
             for code in [*range(0x600), *range(0x2000, 0x2100), *range(0x30F0, 0x3100), 0xFF07]]
    texts += [(-1, None), (-2, ""), (None, "the The THE"), (None, "the"), (-3, "same"),
              (-3, "SAME same"), (-4, "a." * 700 + " b " + "x" * 255 + " " + "y" * 256 + " c"),
              (-5, "a." * 700 + " b " + "x" * 256 + " 中文 ΑΣ l’été")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    tokens = docs.select("doc_id", case_tokens(F.col("text")).alias("tokens"))
    groups = postings_of_doc(F.col("tokens"))
    length = F.size(F.filter("tokens", kept)).alias("doc_len")
    expected = [tokens.select(F.lit(field).alias("field"), "doc_id", length,
                              F.inline(terms)).select(
        "field", "term", "doc_id", F.size("positions").alias("tf"), "positions", "doc_len")
        for field, terms in (("content", folded_postings(groups)), ("content_case", groups))]
    expected = sorted(map(str, expected[0].unionByName(expected[1]).collect()))
    assert sorted(map(str, postings(docs).collect())) == expected
    assert "MapInArrow" in postings(docs)._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_postings_come_in_the_order_of_the_index(monkeypatch):
    import pyarrow as pa

    from corpuslens.functions import grouping

    def rows(chars):
        monkeypatch.setattr(grouping, "CHUNK_CHARS", chars)
        kind = pa.struct([("text", pa.string()), ("tokens", pa.list_(pa.string())),
                          ("small", pa.list_(pa.string()))])
        found = pa.array([{"text": "b a B"}, {"tokens": ["Ω", "b"], "small": ["ω", "b"]},
                          {"text": "a a"}, {"text": ""}], kind)
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None]), found], ["doc_id", "row"])
        return [[tuple(r.values()) for r in b.to_pylist()]
                for b in grouping.sorted_postings([batch])]

    whole = [r for part in rows(1 << 20) for r in part]
    assert [r[:3] for r in whole] == sorted(r[:3] for r in whole)
    assert ("content", "b", 1, 2, [0, 2], 3) in whole
    assert ("content", "ω", 2, 1, [0], 2) in whole
    parts = rows(4)
    assert len(parts) > 2 and sorted(r for part in parts for r in part) == sorted(whole)
