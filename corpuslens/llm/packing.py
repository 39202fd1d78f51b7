"""Packing: documents as token spans in sequences of at most ``capacity`` tokens.

Tasks encode whole documents and cut overlong ones into full windows; what is left of a document
is one shorter piece. Pieces are rows of a few numbers, written once. They are dealt by number to
groups of about ``PIECES_PER_GROUP``, and each group is packed by best-fit decreasing: the
longest piece first, each into the open window with the least room that still takes it. A
segment tree over remaining room finds that window. A group wastes about one window, so padding
stays small; no group grows with the input.

Encoding by words: blanks and line feeds always part the tokenizer's words, so a text's ids are
those of its chunks between them, and frequent chunks are kept. A chunk of Latin letters with
closing punctuation goes straight to the tokenizer's model; every other one is encoded by the
tokenizer as it is.

Defined cases: a null text counts as empty and is the closing id alone; rows with equal or null
ids stay apart as pieces of their own; texts of any length are cut; other columns are left out.
No rows give no rows. The same files give the same packing.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.batches import Kept
from corpuslens.operators.bounded import checkpointed

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
CAPACITY = 4096
PIECES_PER_GROUP = 10_000
KEPT_CHUNKS = 300_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
CLOSING = ".,;:!?%&$*#()[]{}|\"-_/+=~@^`"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Token ids of texts as bytes, four to an id, little-endian."""

    def __init__(self, tokenizer: str = TOKENIZER, kept: int = KEPT_CHUNKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words = Kept(self._word, kept)
        self.chunks = Kept(self._chunk, kept)

    def _word(self, word: str) -> bytes:
        """A word that the tokenizer does not part any further."""
        shown = word if word.isascii() else "".join(
            map(self.letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(CLOSING)
        if core.isalpha() and max(core) < "ɐ" and unicodedata.is_normalized("NFC", core):
            low = core.lower()
            if low.isalpha():
                tail = chunk[len(core):]
                return self.words[low] + (self.words[tail] if tail else b"")
        return np.array(
            self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.chunks.__getitem__, chunks))


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One encoder for a worker process."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 capacity: int = CAPACITY) -> DataFrame:
    """Full windows and the rest of each document: ``PIECES`` and ``ids``."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            out = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), total, part)
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pieces, PIECES + ", ids binary")


class RoomTree:
    """How many open windows have each remaining room; finds the least room that is enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that some window has."""
        count, node = self.count, self.leaves + need
        if count[node]:
            return need
        while node > 1:  # up to the first subtree to the right that has windows, then down left
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not count[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(lengths, capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; the lengths come in decreasing order."""
    tree, open_windows, filled = RoomTree(capacity), defaultdict(list), 0
    windows, offsets = [], []
    for length in lengths:
        room = tree.tightest(length)
        if room is None:
            window, room, filled = filled, capacity, filled + 1
        else:
            window = open_windows[room].pop()
            tree.add(room, -1)
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            open_windows[room - length].append(window)
            tree.add(room - length, 1)
    return windows, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY,
         group_size: int = PIECES_PER_GROUP) -> DataFrame:
    """``PACKED``: where each piece lies. ``pieces`` holds ``PIECES`` and is read more than once,
    so write or checkpoint it before."""
    groups = max(1, math.ceil(pieces.count() / group_size))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        windows, offsets = best_fit(rows["length"].tolist(), capacity)
        return rows.assign(
            sequence_id=(rows["group_"].to_numpy() << 32) + np.array(windows, "int64"),
            offset=np.array(offsets, "int64"))[[c.split()[0] for c in PACKED.split(", ")]]

    dealt = pieces.withColumn("group_", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("group_").applyInPandas(packed, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                   capacity: int = CAPACITY, group_size: int = PIECES_PER_GROUP) -> DataFrame:
    """Encode, cut and pack documents ``doc_id, text``: one row per piece."""
    pieces = checkpointed(token_pieces(docs, tokenizer, end_id, capacity).drop("ids"))
    return pack(pieces, capacity, group_size)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str = TOKENIZER,
              end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, of documents with distinct ids.

    Documents are encoded once more, which costs less than shuffling all ids beforehand.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity).select("doc_id", "start", "ids")
    placed = packed.select("doc_id", "start", "sequence_id", "offset").join(
        pieces, ["doc_id", "start"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""),
                         lambda whole, part: F.concat(whole, part))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
