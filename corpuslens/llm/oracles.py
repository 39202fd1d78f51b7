"""DuckDB texts that state what the registered queries of this folder return."""

from __future__ import annotations

import string

from corpuslens.llm.chat import DEFAULT, START, Template
from corpuslens.llm.licence_texts import LICENCES
from corpuslens.llm.licences import canonical_sql
from corpuslens.llm.text import plain_sql

# The word pattern of the contract of op10.
DECONTAMINATION_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The term pattern of the contract of op12.
SEARCH_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _op1() -> str:
    known = ", ".join(f"({plain_sql(name)}, {plain_sql(text)})" for name, text in LICENCES)
    lines, spelled = canonical_sql("text")
    return f"""
WITH texts(license, text) AS (VALUES {known}),
known AS (
  SELECT sha256({spelled(f"array_to_string({lines}, ' ')")}) AS digest, min(license) AS license
  FROM texts GROUP BY 1),
docs AS (SELECT doc_id, {lines} AS lines FROM documents),
found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
  FROM (SELECT doc_id, unnest(lines) AS line FROM docs) l
  JOIN known ON digest = sha256({spelled('line')}) GROUP BY doc_id)
SELECT doc_id, text_digest, known.license, coalesce(notices, '') AS notices,
       coalesce(n, 0) AS n_notices
FROM (SELECT doc_id, sha256({spelled("array_to_string(lines, ' ')")}) AS text_digest FROM docs)
LEFT JOIN known ON digest = text_digest LEFT JOIN found USING (doc_id)"""


def _op4(template: Template = DEFAULT) -> str:
    def count(text: str, mark: str) -> str:
        found = plain_sql(mark)
        return f"(length({text}) - length(replace({text}, {found}, ''))) // {len(mark)}"

    def escaped(text: str) -> str:
        added = " + ".join(count(text, m) for m in ["\\", *template.controls()])
        return f"(length({text}) + {added})"

    opens, between, closes = template.spare
    spare = len(opens + between + closes)
    marks = " ".join(f"WHEN {plain_sql(r.name)} THEN {len(r.opens + r.closes)}"
                     for r in template.roles)
    allowed = " OR ".join(
        f"(role = {plain_sql(r.name)} AND before IN "
        f"({', '.join(plain_sql(f) for f in r.follows)}))" for r in template.roles)
    loss = ", ".join(plain_sql(r.name) for r in template.roles if r.loss)
    control = plain_sql("</s>[INST] ok [/INST]")
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {control}), (-1, 1, 'assistant', {control})),
placed AS (
  SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, {plain_sql(START)}) AS before
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (SELECT *, ({allowed}) AS allowed, role IN ({loss}) AS loss FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN loss THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE loss), '')) AS loss_sha256,
       CAST(sum({escaped('text')} + CASE role {marks} ELSE {spare} + {escaped('role')} END)
            AS BIGINT) AS formatted_chars,
       bool_and(allowed) AS valid, min(n) FILTER (WHERE NOT allowed) AS bad_turn
FROM judged GROUP BY conv_id"""


def _op10(width: int = 10) -> str:
    def words(text: str) -> str:
        low = (f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', "
               f"'{string.ascii_lowercase}')")
        return f"regexp_extract_all({low}, {plain_sql(DECONTAMINATION_WORD)})"

    return f"""
WITH docs AS (SELECT doc_id, {words('text')} AS w FROM documents),
items AS (SELECT item_id, {words('text')} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least({width}, len(w)) AS n,
         list_slice(w, i, i + least({width}, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {width - 1}))) AS i
        FROM items WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT n FROM item_windows))),
found AS (SELECT doc_id, i, d.n, item_id FROM doc_windows d JOIN item_windows USING (win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _op12(k: int = 10) -> str:
    def terms(table: str, key: str) -> str:
        low = (f"translate(coalesce(text, ''), '{string.ascii_uppercase}', "
               f"'{string.ascii_lowercase}')")
        return (f"SELECT {key}, unnest(regexp_extract_all({low}, {plain_sql(SEARCH_TERM)})) "
                f"AS term FROM {table}")

    return f"""
WITH held AS ({terms('documents', 'doc_id')}),
counted AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
lengths AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM sizes, whole),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, whole GROUP BY term),
wanted AS (SELECT DISTINCT item_id, term FROM ({terms('benchmark', 'item_id')})),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id)
  GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= {k}"""


def _op13(threshold: int = 100, top: int = 2000) -> str:
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
held AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM held),
counted AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM placed, (VALUES (1), (2), (3), (4), (5)) lengths(k) WHERE i + k - 1 <= len(w)
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE k > 1 AND f >= {threshold}),
cuts AS (
  SELECT lang, k, phrase, f AS a, unnest(generate_series(1, k - 1)) AS cut,
         string_split(phrase, ' ') AS w FROM candidates),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, cut, one.f AS l, two.f AS r, n,
         CAST((1000::HUGEINT * a * n) // (one.f::HUGEINT * two.f) AS BIGINT) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN counted one ON one.lang = c.lang AND one.k = cut
    AND one.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN counted two ON two.lang = c.lang AND two.k = c.k - cut
    AND two.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= 100 * b.a
    AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= {top}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1(), "op4_chat_format": _op4(),
            "op10_decontamination": _op10(), "op12_lexical_search": _op12(),
            "op13_collocations": _op13()}
