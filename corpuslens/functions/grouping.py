"""Postings of a batch of documents, grouped and sorted with numpy and Arrow inside a task.

Texts of the characters in ``PLAIN`` are cut into words here; all others come as tokens that
Spark's regular expressions found. For plain texts the rules of ``functions/text.py`` come down to
``WORD``: no scripts of their own, no marks, and digits are ASCII. A word of many parts is one
match here; there its first part holds its place and the rest is dropped, and neither is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuslens.functions.text import MAX_TOKEN
from corpuslens.schema import FIELD, FIELD_CASE

# Latin letters without marks, general punctuation and currency signs: inside of a character class,
# in Python's and Java's syntax alike.
PLAIN = "\x00-\u024f\u2000-\u206f\u20a0-\u20bf"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
WORD = re.compile(
    rf"[0-9_{LETTERS}]+(?:(?:(?<=[{LETTERS}])[.'\u2018\u2019\u2024:\xb7\u2027](?=[{LETTERS}])"
    rf"|(?<=[0-9])[.'\u2018\u2019\u2024,;\u2044](?=[0-9]))[0-9_{LETTERS}]+)*")
# Characters of text that are grouped at a time, and rows handed on at a time.
CHUNK_CHARS = 8 << 20
CHARS_A_WORD = 8
CHUNK_ROWS = 1 << 16

SCHEMA = pa.schema([
    ("field", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("tf", pa.int32()),
    ("positions", pa.list_(pa.int32())), ("doc_len", pa.int32())])


def _words(texts: pa.Array, tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows in one array, and how many each row has."""
    given = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts, counts, run = [], given.copy(), []
    for i, text in enumerate(texts.to_pylist()):
        if text is not None:
            found = WORD.findall(text)
            counts[i] = len(found)
            run += found
        elif given[i]:
            parts += [pa.array(run, pa.string()), tokens.slice(i, 1).flatten()]
            run = []
    parts.append(pa.array(run, pa.string()))
    return pa.concat_arrays(parts), counts


def _lowered(words: pa.Array, tokens: pa.Array, small: pa.Array) -> pa.Array:
    """Distinct words in lower case: letter by letter, or as Spark says where it gave the word."""
    plain, given = pc.utf8_lower(words), tokens.flatten()
    if not len(given):
        return plain
    return pc.coalesce(small.flatten().take(pc.index_in(words, given)), plain)


def _ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The rank of each word among the distinct ones in byte order, and these in order."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _field(name: str, term: np.ndarray, terms: pa.Array, doc: np.ndarray, place: np.ndarray,
           ids: pa.Array, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each term of a document, in the order of the terms, then of the documents. The
    words come in the order of the documents, so that two stable passes over the terms do."""
    order = np.argsort((term & 0xFFFF).astype(np.uint16), kind="stable")
    if len(terms) > 1 << 16:
        order = order[np.argsort((term >> 16).astype(np.uint16)[order], kind="stable")]
    term, doc, place = term[order], doc[order], place[order].astype(np.int32)
    starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    ends = np.r_[starts, len(term)]
    term, doc = term[starts], doc[starts]
    for at in range(0, len(starts), CHUNK_ROWS):
        rows = slice(at, at + CHUNK_ROWS)
        bounds = ends[at:at + CHUNK_ROWS + 1]
        positions = pa.ListArray.from_arrays(
            pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(place[bounds[0]:bounds[-1]]))
        yield pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(name), len(bounds) - 1), terms.take(pa.array(term[rows])),
            ids.take(pa.array(doc[rows])), pa.array(np.diff(bounds).astype(np.int32)), positions,
            pa.array(lengths[doc[rows]].astype(np.int32))], schema=SCHEMA)


def _chunk(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, texts, tokens, small = rows.columns
    words, counts = _words(texts, tokens)
    doc = np.repeat(np.arange(len(ids)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = pc.less_equal(pc.utf8_length(words), MAX_TOKEN).to_numpy(zero_copy_only=False)
    if not kept.all():
        words, doc, place = words.filter(pa.array(kept)), doc[kept], place[kept]
    lengths = np.bincount(doc, minlength=len(ids))
    term, terms = _ranked(words)
    folded, small_terms = _ranked(_lowered(terms, tokens, small))
    yield from _field(FIELD, folded[term], small_terms, doc, place, ids, lengths)
    yield from _field(FIELD_CASE, term, terms, doc, place, ids, lengths)


def sorted_postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of batches of ``doc_id`` and a struct ``text, tokens, small``, which has a text or
    tokens. Each chunk is sorted by field, term and the order of its documents."""
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.column(1).flatten()], ["doc_id", "text", "tokens", "small"])
        sizes = np.cumsum(pc.add(
            pc.binary_length(batch.column(1)).fill_null(0),
            pc.multiply(batch.column(2).value_lengths().fill_null(0), CHARS_A_WORD)).to_numpy(
                zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(sizes):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_CHARS, "right")))
            yield from _chunk(batch.slice(at, end - at))
            at = end
