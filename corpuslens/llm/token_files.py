"""Token ids in binary files: canonical, length-limited Huffman codes made from global counts.

1. Tasks encode whole texts; the ids of each document are written once, as a table.
2. Tasks count their ids, one sum over all of them gives at most one row per vocabulary entry
   (``MOST_SYMBOLS`` bounds it), and the driver makes the code lengths from these: package-merge,
   no code longer than ``LIMIT`` bits. Codes follow from the lengths alone (canonical).
3. Documents are dealt into ranges of ``doc_id`` and sorted; every task writes one file of
   segments of about ``SEGMENT_IDS`` ids. Segments can be read by themselves: a segment holds the
   code lengths, its documents, its bits, and a checkpoint (a bit offset) for every ``BLOCK`` ids.
4. A manifest table names file, place and counts of every segment. It is written by Spark, so that
   only files of successful tasks count; a lost task leaves a file that nobody names.
5. The reader starts at all checkpoints of a segment at once: each step looks up the next ``LIMIT``
   bits of every block in one table of 2^LIMIT entries. Sums over the manifest, first by file and
   then within, give the place of each segment in the whole.

Nothing but the counts passes the driver; a task holds a segment, or one longer document.

Encoding by words: in a byte-level vocabulary a blank after a character that is no white space
always starts a new word, so a text's ids are those of its chunks between such blanks, and frequent
chunks are kept. A text that spells a special token is encoded whole.

Defined cases: a null text counts as empty and is the end id alone; rows with a null id come first;
rows of one id follow each other in the order of reading, and each has its own row in the result;
other columns are left out; no rows give no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.batches import Kept, slices
from corpuslens.llm.packing import byte_letters
from corpuslens.llm.text import written
from corpuslens.operators.bounded import shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
LIMIT = 20  # bits of the longest code
MOST_SYMBOLS = 1 << LIMIT  # a larger vocabulary has no such code
BLOCK = 512  # ids between two checkpoints
PACKED_AT_ONCE = BLOCK << 8
SEGMENT_IDS = 4_000_000
FILE_IDS = 32_000_000
KEPT_CHUNKS = 600_000
TEXT_CHARS = 16_000_000  # characters that a task encodes at once
MAGIC = b"IDS1"
CLOSING = ".,;:!?%&$*#()[]{}|\"-_/+=~@^`"
UNEVEN = re.compile(r"\s ")
STARTS = re.compile(r"(?<=\S)(?=[ \n])")
ENCODED = "row_ long, doc_id long, n_tokens long, ids binary"
MANIFEST = "part int, segment int, file string, at long, size long, docs long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ByteEncoder:
    """Token ids of texts, as bytes of ``kind``."""

    def __init__(self, tokenizer: str = TOKENIZER, kept: int = KEPT_CHUNKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.blank, self.kind = self.letters[ord(" ")], id_kind(self.tokenizer.get_vocab_size())
        self.code = "H" if self.kind == "u2" else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = Kept(self._chunk, kept)  # each with a blank before it
        self.others = Kept(self._other, kept)

    def bytes_of(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: str, before: str = "") -> bytes:
        """A word that the tokenizer does not part any further."""
        shown = word if word.isascii() else "".join(
            map(self.letters.__getitem__, word.encode()))
        return self.bytes_of([t.id for t in self.tokenize(before + shown)])

    def _encoded(self, text: str) -> bytes:
        return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _other(self, text: str) -> bytes:
        """As it stands; letters with closing marks are two words."""
        core = text.rstrip(CLOSING)
        if not core.isalpha():
            return self._encoded(text)
        return self._word(core) + (self.others[text[len(core):]] if core != text else b"")

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk, self.blank)
        core = chunk.rstrip(CLOSING)
        if core.isalpha():
            return self.chunks[core] + self.others[chunk[len(core):]]
        lines = chunk.split("\n")
        if len(lines) > 1 and lines == chunk.split():  # one line feed between words is a word
            return self.chunks[lines[0]] + b"".join(
                self.others["\n"] + self.others[line] for line in lines[1:])
        return self._encoded(" " + chunk)

    def _odd(self, text: str) -> bytes | None:
        """The ids of a text that blanks do not part into chunks, else None."""
        if any(s in text for s in self.special):
            return self._encoded(text)
        if UNEVEN.search(text):
            return b"".join(map(self.others.__getitem__, STARTS.split(text)))
        return None

    def ids(self, texts: list[str], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by ``end``, and where each text begins (one more at
        the end). Chunks are told apart by Arrow; Python sees each different one once."""
        odd = [self._odd(t) if t else b"" for t in texts]
        split = pc.split_pattern(pa.array(
            ["" if o is not None else t for t, o in zip(texts, odd)], pa.string()), " ")
        first = split.offsets.to_numpy()
        names = split.values.dictionary_encode()
        own = list(map(self.chunks.__getitem__, names.dictionary.to_pylist()))
        heads = [self.others[t.split(" ", 1)[0]] if o is None else o for t, o in zip(texts, odd)]
        # One entry for each chunk, each text's beginning, and the end; one number for each place.
        entries = [*own, *heads, self.bytes_of(end)]
        at = names.indices.to_numpy().astype(np.int64)
        at[first[:-1]] = len(own) + np.arange(len(texts))
        at = np.insert(at, first[1:], len(entries) - 1)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // array(self.code).itemsize
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(entries), self.kind)[
            np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[first + np.arange(len(first))]


_encoders: dict[str, ByteEncoder] = {}


def encoder(tokenizer: str) -> ByteEncoder:
    """One encoder for a worker process."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = ByteEncoder(tokenizer)
    return _encoders[tokenizer]


def id_kind(vocabulary: int) -> str:
    """How ids are kept between two passes (in the files they are codes)."""
    return "u2" if vocabulary <= 1 << 16 else "u4"


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``ENCODED`` of documents ``doc_id, text``: all ids of a row, the end id included."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch, texts in slices(whole, "text", TEXT_CHARS):
                ids, starts = encode.ids(texts, [end_id])
                width = ids.dtype.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [
                    None, pa.py_buffer(width * starts), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.diff(starts)),
                     packed.cast(pa.binary())], names=["row_", "doc_id", "n_tokens", "ids"])

    return docs.select(F.monotonically_increasing_id().alias("row_"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, ENCODED)


# Codes --------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code: the least sum of counts times bits with no code above ``limit``
    (package-merge). Symbols that do not occur get 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no codes of at most {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.int64)
    merged, own = coins, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        own.append(order < n)
    taken, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_coin in reversed(own):
        coins_taken = int(is_coin[:taken].sum())
        bits[:coins_taken] += 1
        taken = 2 * (taken - coins_taken)
    lengths[used] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Symbols in the order of their codes."""
    used = np.flatnonzero(lengths)
    return used[np.lexsort((used, lengths[used]))]


def codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, as a number of as many bits as its length."""
    order = canonical(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(order):
        bits = lengths[order].astype(np.uint64)
        longest = bits[-1]
        step = np.left_shift(np.uint64(1), longest - bits)
        first = np.cumsum(step) - step
        out[order] = first >> (longest - bits)
    return out


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next bits the symbol and its length (the low five bits), and how many
    bits are looked at."""
    order = canonical(lengths)
    if not len(order):
        return np.zeros(1, np.int64), 0
    bits = lengths[order].astype(np.int64)
    longest = int(bits[-1])
    table = np.zeros(1 << longest, np.int64)
    filled = np.repeat(order.astype(np.int64) << 5 | bits, 1 << (longest - bits))
    table[:len(filled)] = filled
    return table, longest


def pack_bits(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray,
              block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all codes as big-endian 32-bit words, and the bit offset of every block."""
    total, words, offsets = 0, [np.zeros(1)], []
    for start in range(0, len(ids), PACKED_AT_ONCE):
        part = ids[start:start + PACKED_AT_ONCE]
        bits = lengths[part].astype(np.int64)
        ends = np.cumsum(bits) + (total & 31)
        at = ends - bits
        word = at >> 5
        shifted = code[part] << (64 - bits - (at & 31)).astype(np.uint64)
        n = (int(ends[-1]) >> 5) + 2
        # No two codes share a bit, so sums are unions; as floats they are exact below 2^53.
        sums = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n)
        sums += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        sums[0] += words[-1][-1]  # the word that the part before began
        words[-1] = words[-1][:-1]
        offsets.append(at[::block] + (total >> 5 << 5))
        total = (total >> 5 << 5) + int(ends[-1])
        words.append(sums[:(int(ends[-1]) >> 5) + 1])
    return (np.concatenate(words).astype(np.uint32).astype(">u4"),
            np.concatenate(offsets) if offsets else np.zeros(0, np.int64))


def unpack_bits(words: np.ndarray, offsets: np.ndarray, n: int, lengths: np.ndarray,
                block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of a segment; all blocks are decoded in step."""
    table, longest = decoding_table(lengths)
    bits = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
    pairs = bits[:-1] << np.uint64(32) | bits[1:]
    at, last = offsets.astype(np.int64), len(pairs) - 1
    out = np.empty((block, len(offsets)), np.int64)
    mask = np.uint64((1 << longest) - 1)
    for step in range(min(block, n)):
        window = pairs[np.minimum(at >> 5, last)]
        found = table[(window >> (64 - longest - (at & 31)).astype(np.uint64) & mask)
                      .astype(np.int64)]
        out[step] = found >> 5
        at = at + (found & 31)
    return out.T.reshape(-1)[:n]


# Files --------------------------------------------------------------------------------------

def _segment(doc_ids: list, counts: list[int], ids: np.ndarray, lengths: np.ndarray,
             code: np.ndarray) -> bytes:
    """Magic, header size, header (JSON), code lengths, documents, checkpoints, bits."""
    words, offsets = pack_bits(ids, lengths, code)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [zlib.compress(lengths.tobytes()),
             np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes(),
             np.array(counts, "<i8").tobytes(), offsets.astype("<i8").tobytes(), words.tobytes()]
    header = json.dumps({"docs": len(doc_ids), "ids": len(ids), "block": BLOCK,
                         "parts": [len(p) for p in parts],
                         "crc32": [zlib.crc32(p) for p in parts]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *parts])


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, how many ids each has, and all ids of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("no segment of token ids")
    begin = 8 + int.from_bytes(data[4:8], "little")
    header, parts = json.loads(data[8:begin]), []
    for size, crc in zip(header["parts"], header["crc32"]):
        parts.append(data[begin:begin + size])
        begin += size
        if len(parts[-1]) != size or zlib.crc32(parts[-1]) != crc:
            raise ValueError("a segment of token ids is damaged")
    n = header["docs"]
    lengths = np.frombuffer(zlib.decompress(parts[0]), np.uint8)
    known = np.frombuffer(parts[1], np.uint8, offset=8 * n)
    doc_ids = [d if k else None
               for d, k in zip(np.frombuffer(parts[1], "<i8", n).tolist(), known)]
    ids = unpack_bits(np.frombuffer(parts[4], ">u4"), np.frombuffer(parts[3], "<i8"),
                      header["ids"], lengths, header["block"])
    return doc_ids, np.frombuffer(parts[2], "<i8"), ids


@dataclass(frozen=True)
class TokenFiles:
    """A folder of files and the table that names their segments."""

    folder: str
    manifest: DataFrame


def id_counts(table: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the ``ids`` of a table; one row per id reaches the driver."""
    kind = id_kind(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            whole = b"".join(ids.as_py() for ids in batch.column(0))
            total += np.bincount(np.frombuffer(whole, kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])],
                                         names=["id", "n"])

    rows = (table.select("ids").mapInArrow(counted, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(vocabulary, np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def write_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID,
              folder: str | None = None, file_ids: int = FILE_IDS,
              segment_ids: int = SEGMENT_IDS) -> TokenFiles:
    """Encode documents ``doc_id, text`` and write their ids in ascending ``doc_id`` order.

    ``folder`` is a new folder on storage that all executors see; by default one in the shared
    folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    if vocabulary > MOST_SYMBOLS:
        raise ValueError(f"a vocabulary of {vocabulary} ids is too large for {LIMIT} bits")
    table = written(encoded(docs, tokenizer, end_id))
    counts, kind = id_counts(table, vocabulary), id_kind(vocabulary)
    lengths = code_lengths(counts)
    packed = zlib.compress(lengths.tobytes())

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
        code, part = codes(lengths), TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        store, root = fs.FileSystem.from_uri(folder)
        out, at, rows = None, 0, []
        doc_ids, held, n = [], [], 0

        def flush() -> None:
            nonlocal out, at, doc_ids, held, n
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
            ids = [np.frombuffer(h, kind) for h in held]
            data = _segment(doc_ids, [len(i) for i in ids], np.concatenate(ids), lengths, code)
            out.write(data)
            rows.append((part, len(rows), name, at, len(data), len(doc_ids), n))
            at, doc_ids, held, n = at + len(data), [], [], 0

        for batch in batches:
            for doc_id, count, ids in zip(batch.column(0).to_pylist(),
                                          batch.column(1).to_pylist(), batch.column(2)):
                doc_ids.append(doc_id)
                held.append(ids.as_py())
                n += count
                if n >= segment_ids:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=[c.split()[0] for c in MANIFEST.split(", ")])

    parts = 1 + int(counts.sum()) // file_ids
    ordered = table.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "row_") \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "row_")
    made = ordered.select("doc_id", "n_tokens", "ids").mapInArrow(files, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return open_ids(spark, folder)


def open_ids(spark: SparkSession, folder: str) -> TokenFiles:
    return TokenFiles(folder, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))


def read_ids(files: TokenFiles, ids: bool = False) -> DataFrame:
    """``READ`` of every document from the files, on request with its ``ids``."""
    folder, manifest = files.folder, files.manifest
    by_part = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    # One row per file, in one task: the only table here whose order spans all files.
    bases = by_part.select("part", F.coalesce(F.sum("n").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("within", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(
        bases, "part").select("part", "segment", "file", "at", "size",
                              (F.col("base") + F.col("within")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as stream:
                    stream.seek(row["at"])
                    doc_ids, counts, all_ids = read_segment(stream.read(row["size"]))
                ends = np.cumsum(counts)
                whole = memoryview(all_ids.astype("<u4").tobytes())
                parts = [whole[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(doc_ids, pa.int64()),
                           pa.array(row["start"] + ends - counts, pa.int64()),
                           pa.array(counts, pa.int64()),
                           pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = [c.split()[0] for c in READ.split(", ")]
                if ids:
                    columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # Few bytes name much work, so the number of tasks is set here, not by size.
    spread = placed.repartition(1 + manifest.count() // 4, "part", "segment")
    return spread.mapInArrow(documents, READ + (", ids binary" if ids else ""))
