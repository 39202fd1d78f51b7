"""DuckDB texts that state, independently of the library, what each registered query returns.

RE2 has no look-around, so the tokenizer marks joining symbols with private-use characters
before it splits, and puts them back afterwards.
"""

from __future__ import annotations

import string

from corpuslens.registry.inputs import (
    ALL_QUERIES,
    FUZZY_WORDS,
    LINE_LITERAL,
    LINE_REGEX,
    NAME_REGEX,
    SIZE_HIGH,
    SIZE_LOW,
)
from corpuslens.schema import DEFAULT_EXTENSIONS

# Joining symbols after letters and after digits, and their marks.
MARKS = dict(zip(".:·’',;", ""))
LETTER_JOINERS = ".:·’'"
DIGIT_JOINERS = ".,;’'"
# DuckDB's edit distance counts bytes, so accented letters become upper-case ones.
ACCENTED = "ßäçèéêíñóöüàâëîïôùûáú"
PLAIN = "ABCDEFGHIJKLMNOPQRSTU"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(values) -> str:
    return ", ".join(_quoted(v) for v in values)


def tokens_of(text: str) -> str:
    """SQL list of the tokens of a SQL text, over-long ones included."""
    for joiners, before, after in ((LETTER_JOINERS, r"[\p{L}\p{M}]", r"\p{L}"),
                                   (DIGIT_JOINERS, r"\p{Nd}", r"\p{Nd}")):
        for joiner in joiners:
            symbol = "\\" + joiner if joiner == "." else joiner
            find = _quoted(f"({before}){symbol}({after})")
            put = _quoted(rf"\1{MARKS[joiner]}\2")
            for _ in range(2):
                text = f"regexp_replace({text}, {find}, {put}, 'g')"
    word = r"[\p{Han}\p{Hiragana}]|[\p{L}\p{M}\p{Nd}_" + "-]+"
    back = f"translate(t, {_quoted(''.join(MARKS.values()))}, {_quoted(''.join(MARKS))})"
    return f"list_transform(regexp_extract_all({text}, {_quoted(word)}), lambda t: {back})"


FILES = """
files AS (
  SELECT doc_id,
         concat('/', source, '/', lang, '/doc', CAST(doc_id AS VARCHAR),
                CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.LOG'
                                WHEN 3 THEN '.py' WHEN 4 THEN '.bin' ELSE '' END) AS path,
         text, CAST(doc_id AS BIGINT) * 1000000 AS mtime_us
  FROM documents),
meta AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS name,
         regexp_extract(path, '(\\.[^./]+)$', 1) AS extension,
         CAST(octet_length(encode(text)) AS BIGINT) AS size
  FROM files)"""

PREV = FILES + """,
prev AS (
  SELECT doc_id, path, text,
         CASE WHEN doc_id % 7 = 0 THEN mtime_us - 1 WHEN doc_id % 7 = 1 THEN mtime_us + 1
              ELSE mtime_us END AS mtime_us
  FROM files WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT -i, concat('/gone/', CAST(i AS VARCHAR), '.txt'), 'the with of the', 0
  FROM range(1, 6) r(i)),
classes AS (
  SELECT m.*, p.doc_id AS prev_doc_id,
         CASE WHEN NOT (lower(extension) IN (""" + _listed(DEFAULT_EXTENSIONS) + """)
                        AND size <= 26214400) THEN 'rejected'
              WHEN p.path IS NULL THEN 'new'
              WHEN p.mtime_us = m.mtime_us THEN 'unchanged' ELSE 'changed' END AS change_class
  FROM meta m LEFT JOIN prev p USING (path)),
following AS (
  SELECT doc_id, path, text, mtime_us FROM prev
  WHERE path NOT IN (SELECT path FROM classes WHERE change_class IN ('new', 'changed'))
  UNION ALL
  SELECT doc_id, path, text, mtime_us FROM classes WHERE change_class IN ('new', 'changed'))"""


def index_of(docs: str) -> str:
    """CTEs ``tok, post, lens, total, vocab`` over a table ``(doc_id, text)``."""
    def field(name: str, text: str) -> str:
        return (f"SELECT '{name}' AS field, doc_id, unnest(toks) AS term, "
                f"generate_subscripts(toks, 1) - 1 AS pos "
                f"FROM (SELECT doc_id, {tokens_of(text)} AS toks FROM {docs})")

    return f"""
tok AS (SELECT * FROM ({field('content', 'lower(text)')} UNION ALL
                       {field('content_case', 'text')}) WHERE length(term) <= 255),
post AS (SELECT field, term, doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions
         FROM tok GROUP BY ALL),
lens AS (SELECT field, doc_id, count(*) AS len FROM tok GROUP BY ALL),
total AS (SELECT count(*) AS n FROM {docs}),
vocab AS (SELECT field, term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY ALL)"""


INDEX = index_of("documents")


def near(words: list[str] | None) -> str:
    """CTEs ``near_terms, expanded`` for lower-case words over the plain field.

    DuckDB's distance lets a swapped pair be edited again, the library's does not. A pair counts
    if two edits without a swap do, or one swap with at most one edit before or after it.
    """
    rows = (f"VALUES {', '.join(f'({_quoted(w)})' for w in words)}" if words else
            "SELECT DISTINCT word FROM (SELECT unnest(list_transform(regexp_split_to_array("
            "text, '[ \\t\\r\\n]+'), lambda x: lower(x))) AS word FROM benchmark) WHERE word <> ''")
    swap = "substring(w, i + 1, 1) || substring(w, i, 1)"

    def letters(text: str) -> str:
        """Which of a-z occur, as bits: an edit changes two at most, so it rules most pairs out."""
        return " + ".join(f"CAST(contains({text}, '{c}') AS BIGINT) * {1 << i}"
                          for i, c in enumerate(string.ascii_lowercase))

    return f"""
words(word) AS ({rows}),
bands AS (SELECT word, {letters('word')} AS held,
                 unnest(range(length(word) - 2, length(word) + 3)) AS size FROM words),
held AS (SELECT term, df, cf, {letters('term')} AS held FROM vocab WHERE field = 'content'),
flat_pairs AS MATERIALIZED (
  SELECT word, term, df, cf, translate(term, '{ACCENTED}', '{PLAIN}') AS t,
         translate(word, '{ACCENTED}', '{PLAIN}') AS w
  FROM held JOIN bands ON length(term) = size AND bit_count(xor(held.held, bands.held)) <= 4),
close_pairs AS MATERIALIZED (
  SELECT * FROM (SELECT *, damerau_levenshtein(t, w) AS distance FROM flat_pairs)
  WHERE distance <= 2),
near_terms AS (
  SELECT word, term, df, cf, distance FROM close_pairs
  WHERE (levenshtein(t, w) <= 2 OR len(list_filter(
    range(1, length(w)), lambda i:
      starts_with(t, substring(w, 1, i - 1) || {swap})
        AND damerau_levenshtein(substring(t, i + 2), substring(w, i + 2)) <= 1
      OR ends_with(t, {swap} || substring(w, i + 2))
        AND damerau_levenshtein(substring(t, 1, greatest(0, length(t) - length(w) + i - 1)),
                                substring(w, 1, i - 1)) <= 1)) > 0)),
boosted AS (
  SELECT *, CASE WHEN distance = 0 THEN 1.0
                 ELSE 1.0 - CAST(distance AS DOUBLE) / least(length(term), length(word)) END AS boost
  FROM near_terms),
expanded AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY boost DESC, term) AS place
                 FROM boosted WHERE boost > 0) WHERE place <= 50)"""


def _values(rows: list[tuple]) -> str:
    def cell(value) -> str:
        return _quoted(value) if isinstance(value, str) else str(value)
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def query_terms(query_ids: list[int]) -> str:
    """CTEs ``asked, qt`` from the clauses that ``inputs`` states for each query."""
    asked, terms, fuzzy = [], [], []
    for query_id in query_ids:
        q = ALL_QUERIES[query_id]
        field = "content_case" if q.case_sensitive else "content"
        n_must = sum(c.occur == "must" for c in q.clauses)
        n_counted = sum(c.occur != "not" for c in q.clauses)
        asked.append((query_id, q.k, field, n_must, n_counted))
        for slot, clause in enumerate(q.clauses):
            if q.kind == "fuzzy":
                fuzzy.append((query_id, slot, clause.terms[0]))
            else:
                terms += [(query_id, q.kind, slot, clause.occur, len(clause.terms), offset, term)
                          for offset, term in enumerate(clause.terms)]
    parts = []
    if terms:
        parts.append(f"""
  SELECT query_id, kind, field, slot, occur, need, off, term, 1.0 AS boost
  FROM (VALUES {_values(terms)}) v(query_id, kind, slot, occur, need, off, term)
  JOIN asked USING (query_id)""")
    if fuzzy:
        parts.append(f"""
  SELECT query_id, 'fuzzy', 'content', slot, 'must', 1, 0, term, boost
  FROM (VALUES {_values(fuzzy)}) v(query_id, slot, word) JOIN expanded USING (word)""")
    words = sorted({w for _, _, w in fuzzy})
    return ((near(words) + "," if fuzzy else "") + f"""
asked(query_id, k, field, n_must, n_counted) AS (VALUES {_values(asked)}),
qt(query_id, kind, field, slot, occur, need, off, term, boost) AS ({' UNION ALL '.join(parts)})""")


# From ``asked, qt`` and the index CTEs to ``scores`` and ``ranked``.
RANKED = """
idfs AS (SELECT qt.*, 1 + ln(n / (coalesce(df, 0) + 1)) AS idf
         FROM qt LEFT JOIN vocab USING (field, term), total),
sums AS (SELECT *, sum(idf) OVER (PARTITION BY query_id) AS idf_sum FROM idfs),
norms AS (SELECT query_id, 1 / sqrt(sum(CASE WHEN occur = 'not' THEN 0
            WHEN kind = 'phrase' THEN idf_sum * idf ELSE pow(idf * boost, 2) END)) AS query_norm
          FROM sums GROUP BY query_id),
starts AS (SELECT query_id, doc_id, pos - off AS start, max(idf_sum) AS idf_sum
           FROM sums JOIN tok USING (field, term) WHERE kind = 'phrase'
           GROUP BY query_id, doc_id, pos - off HAVING count(*) = max(need)),
phrases AS (SELECT query_id, doc_id, count(*) AS freq, max(idf_sum) AS idf_sum
            FROM starts GROUP BY query_id, doc_id),
slots AS (
  SELECT query_id, doc_id, occur, sum(sqrt(tf) * idf * idf * boost) AS part
  FROM sums JOIN post USING (field, term) WHERE kind <> 'phrase'
  GROUP BY query_id, doc_id, slot, occur HAVING count(*) >= max(need)
  UNION ALL
  SELECT query_id, doc_id, 'must', sqrt(freq) * pow(idf_sum, 2) FROM phrases),
per_doc AS (
  SELECT query_id, doc_id, count(*) FILTER (occur = 'must') AS must,
         count(*) FILTER (occur = 'should') AS should, count(*) FILTER (occur = 'not') AS banned,
         coalesce(sum(part) FILTER (occur <> 'not'), 0) AS total
  FROM slots GROUP BY query_id, doc_id),
exact AS (SELECT field, doc_id, 1 / sqrt(len) AS f FROM lens),
enc AS (SELECT field, doc_id, floor(f / pow(2, floor(log2(f))) * 4) / 4 * pow(2, floor(log2(f)))
               AS norm FROM exact),
scores AS (
  SELECT query_id, doc_id, k,
         round((must + should) / n_counted * query_norm * total * norm, 6) AS score
  FROM per_doc JOIN asked USING (query_id) JOIN norms USING (query_id)
       JOIN enc USING (field, doc_id)
  WHERE must = n_must AND banned = 0 AND must + should > 0),
ranked AS (
  SELECT query_id, rank, doc_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
        FROM scores) WHERE rank <= k)"""


def ranking(query_ids: list[int], select: str = "SELECT * FROM ranked") -> str:
    return f"WITH {INDEX}, {query_terms(query_ids)}, {RANKED} {select}"


def snippet_sql(text: str, query: str, terms: list[str]) -> str:
    """Snippet of a query without symbols, case ignored, as nested SQL expressions."""
    flat = f"translate({text}, chr(13) || chr(10), '  ')"
    at = "coalesce(" + ", ".join(
        f"nullif(strpos(lower({flat}), {_quoted(t.lower())}), 0)" for t in terms) + ")"
    start = f"greatest(0, {at} - 121)"
    end = f"least(length({flat}), {at} - 1 + {len(query)} + 120)"
    cut = f"substring({flat}, {start} + 1, {end} - {start})"
    marked = f"regexp_replace({cut}, {_quoted('(' + '|'.join(terms) + ')')}, '**\\1**', 'gi')"
    return (f"CASE WHEN regexp_matches({text}, '^\\s*$') THEN '' "
            f"WHEN {at} IS NULL THEN substring({flat}, 1, 240) ELSE {marked} END")


def _hits(query_id: int) -> str:
    q = ALL_QUERIES[query_id]
    terms = [q.text] if q.kind == "phrase" else q.text.split()
    return ranking([query_id], f"""
SELECT query_id, rank, path, {snippet_sql('text', q.text, terms)} AS snippet, score,
       'index' AS source
FROM ranked JOIN files USING (doc_id)""").replace("WITH ", f"WITH {FILES}, ", 1)


def _files(select: str) -> str:
    return f"WITH {FILES} {select}"


def _index(select: str) -> str:
    return f"WITH {INDEX} {select}"


def _refresh(select: str) -> str:
    return f"WITH {PREV} {select}"


_REASON = f"""CASE WHEN size > {SIZE_HIGH} OR size < {SIZE_LOW} THEN 'size'
  WHEN lower(extension) IN ('.bin') THEN 'excluded'
  WHEN lower(extension) NOT IN ('.txt', '.md', '.log', '.bin') THEN 'not included'
  WHEN doc_id % 5 = 0 AND size > 10 THEN 'binary' END"""
_LINES = ("SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM ("
          "SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS ls FROM ("
          "SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))")
_FLAT = "translate(text, chr(13) || chr(10), '  ')"
_ENTRIES = """, folders AS (
  SELECT DISTINCT regexp_extract(path, '^/[^/]+') AS path FROM files
  UNION SELECT DISTINCT regexp_extract(path, '^/[^/]+/[^/]+') FROM files),
entries AS (
  SELECT path, name, extension, size, FALSE AS is_directory FROM meta
  UNION ALL
  SELECT path, regexp_extract(path, '[^/]*$'), NULL, NULL, TRUE FROM folders)"""
_SCAN_STATS = f"""SELECT count(*) FILTER (reason IS NULL) AS files_scanned,
  count(*) FILTER (reason IS NULL AND hit) AS matches_found,
  count(*) FILTER (reason IS NOT NULL) AS files_skipped
  FROM (SELECT {_REASON} AS reason, contains(lower(text), '{LINE_LITERAL}') AS hit FROM meta)"""
_REFRESHED_TERMS = f"WITH {PREV}, {index_of('following')}"
_BATCH = f"""WITH {INDEX},
items AS (SELECT item_id AS query_id, {tokens_of('lower(text)')} AS toks FROM benchmark),
qt AS (SELECT query_id, 'plain' AS kind, 'content' AS field, slot, 'must' AS occur, 1 AS need,
              0 AS off, term, 1.0 AS boost
       FROM (SELECT query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS slot
             FROM items)),
asked AS (SELECT query_id, 20 AS k, 'content' AS field, len(toks) AS n_must,
                 len(toks) AS n_counted FROM items),
{RANKED} SELECT * FROM ranked"""

# The token table is read once, and only two of its terms meet.
_J3 = f"""WITH {INDEX},
two AS MATERIALIZED (SELECT doc_id, pos, term FROM tok
                     WHERE field = 'content' AND term IN ('of', 'the'))
SELECT a.doc_id, a.pos AS start FROM two a JOIN two b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
WHERE a.term = 'of' AND b.term = 'the'"""


def _near_statement(select: str, words: list[str] | None = FUZZY_WORDS) -> str:
    """Over the vocabulary of the plain field, counted from tokens without their positions."""
    return f"""WITH all_tokens AS (
  SELECT doc_id, unnest({tokens_of('lower(text)')}) AS term FROM documents),
vocab AS MATERIALIZED (
  SELECT 'content' AS field, term, count(DISTINCT doc_id) AS df, count(*) AS cf
  FROM all_tokens WHERE length(term) <= 255 GROUP BY term), {near(words)} {select}"""


def _mode(case: int, hits: str, source: str, counters: str, said: str) -> str:
    return (f"SELECT {case} AS case_id, {hits} AS hits, "
            f"CASE WHEN {hits} > 0 THEN '{source}' ELSE '' END AS source, {counters}, "
            f"'{said}' AS said FROM seen")


_SCANNED = ("files AS files_scanned, {0} AS matches_found, 0 AS files_skipped")
_NOTHING = "0 AS files_scanned, 0 AS matches_found, 0 AS files_skipped"
_INDEXED = "0 AS files_scanned, least(200, docs) AS matches_found, 0 AS files_skipped"
_MODES = f"""WITH {FILES}, {INDEX}, seen AS (
  SELECT count(*) AS files, count(*) FILTER (contains(lower(name), 'doc1')) AS names,
         count(*) FILTER (contains(lower(text), '{LINE_LITERAL}')) AS lines,
         (SELECT count(*) FROM post WHERE field = 'content' AND term = '{LINE_LITERAL}') AS docs
  FROM meta)
""" + " UNION ALL ".join([
    _mode(0, "names", "scan", _SCANNED.format("names"), ""),
    _mode(1, "lines", "scan", _SCANNED.format("lines"), ""),
    _mode(2, "0", "", _NOTHING,
          "warning: Regex search is not available when using the content index."),
    _mode(3, "lines", "scan", _SCANNED.format("lines"),
          "status: Regex search requested. Falling back to scan mode."),
    _mode(4, "0", "", _NOTHING, "warning: No content index found at ''/no/index''."),
    _mode(5, "lines", "scan", _SCANNED.format("lines"),
          "status: No content index found. Falling back to scan mode."),
    _mode(6, "least(200, docs)", "index", _INDEXED, ""),
    _mode(7, "least(200, docs)", "index", _INDEXED, "")])


def oracle_sql() -> dict[str, str]:
    out = {
        # Sources and sinks
        "S1_list_files": _files("SELECT path, size FROM meta"),
        "S2_list_files_for_index": _files("SELECT path, extension, size FROM meta"),
        "S3_decode_text": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(65533) "
                          "ELSE text END AS text FROM documents",
        "S4_catalogue": f"WITH {FILES} {_ENTRIES} SELECT * FROM entries",
        "S5_catalogue_rebuild": f"WITH {FILES} {_ENTRIES} SELECT * FROM entries",
        "S8_lines": f"SELECT doc_id, line_no, line FROM ({_LINES})",
        "S9_saved_index": _index("SELECT field, term, df, cf FROM vocab"),
        "S10_index_rebuild": _index("SELECT field, doc_id, len FROM lens"),
        "S13_saved_hits": _files("SELECT path, '' AS snippet, 'scan' AS source FROM files "
                                 f"WHERE contains(lower(text), '{LINE_LITERAL}')"),
        "S14_corpus_table": _files("SELECT doc_id, path, text, mtime_us FROM files"),
        # Filters
        "F1_size_range": _files("SELECT path, size FROM meta "
                                f"WHERE size BETWEEN {SIZE_LOW} AND {SIZE_HIGH}"),
        "F2_exclude_extensions": _files("SELECT path FROM meta "
                                        "WHERE lower(extension) NOT IN ('.log', '.bin')"),
        "F3_include_extensions": _files("SELECT path FROM meta "
                                        "WHERE lower(extension) IN ('.log', '.md')"),
        "F4_binary": "SELECT doc_id, octet_length(encode(text)) < 512 AS is_binary FROM documents",
        "F5_index_extensions": _files("SELECT path FROM meta WHERE lower(extension) IN "
                                      f"({_listed(DEFAULT_EXTENSIONS)})"),
        "F6_index_size": _files("SELECT path, size FROM meta WHERE size <= 2000"),
        "F7_name_literal": _files("SELECT path, contains(name, 'LOG') AS exact, "
                                  "contains(lower(name), 'log') AS folded FROM meta"),
        "F8_name_regex": _files("SELECT path, name FROM meta "
                                f"WHERE regexp_matches(name, '(?i){NAME_REGEX}')"),
        "F9_line_literal": _files("SELECT path FROM files "
                                  f"WHERE contains(lower(text), '{LINE_LITERAL}')"),
        "F10_line_regex": f"SELECT DISTINCT doc_id FROM ({_LINES}) "
                          f"WHERE regexp_matches(line, '{LINE_REGEX}')",
        "F12_skip_reason": _files(f"SELECT path, {_REASON} AS skip_reason FROM meta"),
        "F13_unchanged": _refresh("SELECT m.path, m.mtime_us = p.mtime_us AS same "
                                  "FROM meta m JOIN prev p USING (path)"),
        "F14_indexable": _files("SELECT path FROM meta WHERE lower(extension) IN "
                                f"({_listed(DEFAULT_EXTENSIONS)}) AND size <= 26214400 "
                                "AND NOT (doc_id % 5 = 0 AND size > 10)"),
        # Projections
        "P1_file_name": _files("SELECT path, name FROM meta"),
        "P2_extension": _files("SELECT path, extension FROM meta"),
        "P3_file_facts": _files("SELECT path, size, mtime_us FROM meta"),
        "P4_tokens": _index("SELECT doc_id, pos, term FROM tok WHERE field = 'content'"),
        "P5_case_tokens": _index("SELECT doc_id, pos, term FROM tok WHERE field = 'content_case'"),
        "P6_query_words": "SELECT conv_id, turn, w AS word FROM (SELECT conv_id, turn, "
                          "unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS w "
                          "FROM conversations) WHERE w <> ''",
        "P7_flat_text": f"SELECT doc_id, {_FLAT} AS flat FROM documents",
        "P8_anchor": "SELECT doc_id, coalesce("
                     f"nullif(strpos(lower({_FLAT}), 'with'), 0), "
                     f"nullif(strpos(lower({_FLAT}), 'der'), 0)) AS at FROM documents",
        "P10_highlight": "SELECT doc_id, regexp_replace("
                         f"{_FLAT}, '(the|ou)', '**\\1**', 'gi') AS marked FROM documents",
        "P11_fallback": f"SELECT doc_id, substring({_FLAT}, 1, 240) AS snippet FROM documents",
        "P12_snippet": "SELECT doc_id, "
                       f"{snippet_sql('text', 'with the', ['with', 'the'])} AS snippet "
                       "FROM documents",
        "P13_fuzzy_words": "SELECT item_id, lower(w) AS word, slot - 1 AS slot FROM ("
                           "SELECT item_id, unnest(a) AS w, generate_subscripts(a, 1) AS slot "
                           "FROM (SELECT item_id, list_filter(regexp_split_to_array(text, "
                           "'[ \\t\\r\\n]+'), lambda x: x <> '') AS a FROM benchmark))",
        "P14_preview": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN "
                       "substring(text, 1, 2000) || '...(truncated)' ELSE text END AS preview "
                       "FROM documents",
        "P15_escape": "SELECT doc_id, '<>' || '|rest' AS rest FROM documents",
        "P16_labels": _files("SELECT path, '' AS snippet, 'scan' AS source FROM files "
                             "WHERE contains(text, 'The')"),
        # Joins
        "J1_change_class": _refresh("SELECT path, change_class FROM classes"),
        "J2_term_lookup": _index("SELECT doc_id, term, tf FROM post WHERE field = 'content' "
                                 "AND term IN ('the', 'with')"),
        "J3_phrase_positions": _J3,
        "J4_live_hits": _live(2),
        "J5_not_term": _index("SELECT DISTINCT doc_id FROM post WHERE field = 'content' AND "
                              "term = 'the' AND doc_id NOT IN (SELECT doc_id FROM post "
                              "WHERE field = 'content' AND term = 'with')"),
        "J6_near_terms": _near_statement("SELECT word, term, distance, df, cf FROM near_terms"),
        "J7_fetched_text": ranking([2], "SELECT query_id, rank, path, text FROM ranked "
                                        "JOIN files USING (doc_id)").replace(
                                            "WITH ", f"WITH {FILES}, ", 1),
        "F11_existing_hits": _live(1),
        # Aggregations
        "A1_postings": _index("SELECT field, term, doc_id, tf, positions FROM post"),
        "A2_vocabulary": _index("SELECT field, term, df, cf FROM vocab"),
        "A2_document_lengths": _index("SELECT field, doc_id, len FROM lens"),
        "A3_all_terms": _index("SELECT doc_id FROM post WHERE field = 'content' "
                               "AND term IN ('the', 'with') GROUP BY doc_id "
                               "HAVING count(*) = 2"),
        "A4_scores": ranking([2], "SELECT query_id, doc_id, score FROM scores"),
        "A5_scan_counters": _files(_SCAN_STATS),
        "A6_index_counters": _refresh(
            "SELECT count(*) FILTER (change_class IN ('new', 'changed')) AS files_indexed, "
            "count(*) FILTER (change_class = 'unchanged') AS files_unchanged, "
            "count(*) FILTER (change_class = 'rejected') AS files_skipped FROM classes"),
        "A7_catalogue_count": f"WITH {FILES} {_ENTRIES} SELECT count(*) AS entries FROM entries",
        "A8_phrase_frequency": ranking([3], "SELECT doc_id, freq FROM phrases"),
        "A9_index_search_counters": ranking(
            [2], "SELECT 0 AS files_scanned, count(*) AS matches_found, 0 AS files_skipped "
                 "FROM ranked"),
        # Windows, sorts, limits, set operations
        "W1_fuzzy_cap": _near_statement(
            "SELECT word, term, round(boost, 6) AS boost, df FROM expanded"),
        "W2_latest_per_path": _refresh(
            "SELECT path, max(mtime_us) AS mtime_us FROM (SELECT path, mtime_us FROM files "
            "UNION ALL SELECT path, mtime_us FROM prev) GROUP BY path"),
        "L1_top_k": ranking([1], "SELECT doc_id, score FROM ranked"),
        "L2_rank_order": ranking([1], "SELECT rank, doc_id FROM ranked"),
        "U1_upsert": _refresh("SELECT path, mtime_us, length(text) AS n_chars FROM following"),
        # Composed entry points
        "E1_scan_search": _files(
            f"SELECT path, '' AS snippet, 'scan' AS source FROM meta WHERE ({_REASON}) IS NULL "
            f"AND contains(lower(text), '{LINE_LITERAL}')"),
        "E2_index_search": _hits(2),
        "E4_search": _hits(2).replace(
            "SELECT query_id, rank, path,", "SELECT path,").replace(
            "AS snippet, score,", "AS snippet,"),
        "E5_refreshed_index": _REFRESHED_TERMS + " SELECT field, term, df, cf FROM vocab",
        "E6_catalogue_status": f"WITH {FILES} {_ENTRIES} "
                               "SELECT count(*) AS entries FROM entries",
        "E7_batch_search": _BATCH,
        "E7_fuzzy_batch": _near_statement(
            "SELECT word, term, distance, df, cf FROM near_terms", None),
        "E4_modes": _MODES,
    }
    start, end = "greatest(0, spot - 121)", "least(length(flat), spot - 1 + 8 + 120)"
    out["P9_window"] = (
        f"SELECT doc_id, substring(flat, {start} + 1, {end} - {start}) AS part "
        f"FROM (SELECT doc_id, {_FLAT} AS flat, nullif(strpos(lower({_FLAT}), 'with'), 0) "
        "AS spot FROM documents) WHERE spot IS NOT NULL")
    for query_id, query in ALL_QUERIES.items():
        if query.key:
            out[query.key] = ranking([query_id])
    return out


def _live(query_id: int) -> str:
    """Top hits over the refreshed index, whose stale rows rank but do not come back."""
    q = query_terms([query_id])
    return (f"WITH {PREV}, {index_of('following')}, {q}, {RANKED} "
            "SELECT query_id, rank, path, score FROM ranked JOIN following USING (doc_id) "
            "WHERE path IN (SELECT path FROM files)")
