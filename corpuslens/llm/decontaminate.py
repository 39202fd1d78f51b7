"""Benchmark decontamination: one automaton over the windows of all items, one scan per text.

Words are runs of ASCII digits, ASCII letters and all other characters than ASCII, with A-Z in
lower case. A window is ``width`` consecutive words of an item; an item of fewer words is one
window. An Aho-Corasick automaton holds every distinct window once, written as words between
single blanks. A task brings a text into the same form, scans it once, and maps what it finds back:
to word numbers, and to places in the original text.

The items must fit into every worker, so their size is looked at first. Up to ``SHARD_BYTES`` of
text they are one automaton; above it the items are dealt to several by id, and a text is scanned
once by each, so that the result is whole and memory bounded at any number of items.

Defined cases: null texts have no words; an item without words has no window and never occurs; an
item without an id hits words but is not counted; items with equal ids are one item; repeated
windows count once; other columns stay, and the added ones replace any of the same name.
No rows give no rows, no items no hits.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 10
SHARD_BYTES = 16 * 1024 * 1024
# A-Z to a-z; every other byte below 128 that is no letter or digit to a blank.
FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
             for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("word", "words", "start", "end")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
         T.StructField("item_ids", T.ArrayType(T.LongType())),
         T.StructField("spans", T.ArrayType(SPAN))]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FORM).split()


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


def automaton(items: list[tuple[int | None, str | None]], width: int):
    """The automaton, and for each of its windows the number of words and the items that have it."""
    found: dict[bytes, set] = {}
    for item_id, text in items:
        for window in windows_of(words_of(text), width):
            found.setdefault(window, set()).add(item_id)
    machine = ahocorasick.Automaton()
    for window, ids in found.items():
        machine.add_word(f" {window.decode('latin-1')} ",
                         (len(window) + 1, window.count(b" ") + 1, frozenset(ids - {None})))
    if found:
        machine.make_automaton()
    return machine if found else None


_machines: dict[str, object] = {}


def _scan(text: str | None, machine) -> tuple[int, np.ndarray, set, list]:
    """Words of a text, which of them are hit, the items found, and the hit stretches."""
    words = words_of(text)
    hit = np.zeros(len(words) + 1, np.int64)
    items: set = set()
    if machine is not None and words:
        form = b" ".join([b"", *words, b""]).decode("latin-1")
        blanks = None
        for end, (length, n, ids) in machine.iter(form):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(form.encode("latin-1"), np.uint8) == 32)
            first = int(np.searchsorted(blanks, end - length))
            hit[first] += 1
            hit[first + n] -= 1
            items |= ids
    return len(words), np.cumsum(hit[:-1]) > 0, items


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Stretches of hit words, with their places in the original text."""
    places = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"word": int(a), "words": int(b - a), "start": places[a][0], "end": places[b - 1][1]}
            for a, b in zip(edges[::2], edges[1::2])]


def find_passages(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``item_ids`` and ``spans`` to documents with a ``text``.

    ``items`` holds ``item_id, text``. ``spans`` are stretches of hit words: the first word's
    number, how many, and start and end in characters of the original text.
    """
    items = items.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    added = {f.name for f in ADDED}
    kept = [f for f in docs.schema.fields if f.name not in added]
    context = docs.sparkSession.sparkContext
    keys = []
    for shard in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows = [(r["item_id"], r["text"]) for r in part.toLocalIterator()]
        keys.append((uuid.uuid4().hex, context.broadcast(rows)))

    def machine(key: str, rows):
        """One automaton at a time in a worker; with one shard it is built once."""
        if key not in _machines:
            _machines.clear()
            _machines[key] = automaton(rows.value, width)
        return _machines[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            hits = [None] * batch.num_rows
            found: list[set] = [set() for _ in hits]
            counts = [0] * batch.num_rows
            for key, rows in keys:
                built = machine(key, rows)
                for i, text in enumerate(texts):
                    counts[i], hit, ids = _scan(text.as_py(), built)
                    found[i] |= ids
                    if hit.any():
                        hits[i] = hit if hits[i] is None else hits[i] | hit
            spans = [[] if h is None else _spans(t.as_py(), h) for t, h in zip(texts, hits)]
            new = [counts, [0 if h is None else int(h.sum()) for h in hits],
                   [sorted(ids) for ids in found], spans]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct(
                [(n, pa.int64()) for n in ("word", "words", "start", "end")]))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept),
                 *(pa.array(v, t) for v, t in zip(new, types))],
                names=[*(f.name for f in kept), *(f.name for f in ADDED)])

    return docs.select(*[f.name for f in kept]).mapInArrow(scan, T.StructType([*kept, *ADDED]))


def without_passages(found: DataFrame) -> DataFrame:
    """Cut the hit stretches out of ``text`` and leave out what ``find_passages`` added."""
    places = F.transform("spans", lambda s: s["start"])
    first = F.when(F.size("spans") == 0, F.col("text")).otherwise(
        F.substring("text", F.lit(1), F.get(places, F.lit(0)).cast("int")))
    rest = F.transform("spans", lambda s, i: F.substr(
        F.col("text"), (s["end"] + 1).cast("int"),
        (F.coalesce(F.get(places, i + 1), F.char_length("text").cast("long")) - s["end"])
        .cast("int")))
    cut = F.concat(first, F.array_join(rest, ""))
    return found.withColumn("text", cut).drop(*[f.name for f in ADDED])
