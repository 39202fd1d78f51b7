"""Language-model scoring: cross-entropy difference between a target and a background model.

Both models are word bigrams over one open vocabulary: words (lower case, closing marks cut off)
and pairs of neighbours are known by 63- and 64-bit hashes, so that no two words share counts, and

    P(word | before) = (n(before, word) + LEAN P(word)) / (n(before) + LEAN),
    P(word) = (n(word) + 1) / (N + V),

with the same smoothing in both; V is the number of different words of the background, ``WORDS``
at least. A document's cross-entropy is its mean loss a token in nats; the score is that of the
target model less that of the background model, so lower is closer to the target.

Every word and every pair of every text is counted, so what is gathered grows with the input.
Texts are dealt into blocks of about ``BLOCK_CHARS``. A block's different keys, sorted, go with
their sums to ``parts`` ranges of keys, as one packed row for each range; a range adds up what its
blocks sent, and answers each block with the sums of the keys it sent, in their order and without
them. A frequent word is one key in each block that has it, and no row holds more than a block or
a range. ``score_within`` counts and scores the same texts, so that keys move once; ``train`` keeps
the summed ranges as a written table, and ``score`` lets other texts ask it.

Defined cases: a null or blank text has no tokens, and null cross-entropies and score; repeated
rows count and score each time; a null target flag counts as false; without any target text both
models differ only by the smoothing; words that were never counted count 0; other columns stay,
and the added ones replace any of the same name. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.batches import Kept, numbered, per_row, rows_of, slices
from corpuslens.llm.text import release, written

# The least size of the vocabulary that smoothing assumes. Each word is a class of its own.
WORDS = CLASSES = 1 << 16
# Characters of text to a block, and to a range of keys.
BLOCK_CHARS, PART_CHARS = 4_000_000, 8_000_000
LEAN, ADD = 100.0, 0.1  # ADD smooths words within a class: without effect in a class of one
START = 0  # before the first word
CLOSING = ".,;:!?\"'()[]{}"
ADDED = ("n_tokens", "target_entropy", "background_entropy", "entropy_difference")
# Of a word: its occurrences, and those with a word after it; of a pair: its occurrences. Each
# in target and background.
PER_WORD, PER_PAIR = 4, 2
SENT = "block long, part int, words binary, word_sums binary, pairs binary, pair_sums binary"
NAMES = ["block", "part", "words", "word_sums", "pairs", "pair_sums"]
KINDS = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
ANSWERED = "block long, part int, word_sums binary, pair_sums binary, totals array<long>"
TOTALS_KIND = pa.list_(pa.int64())
FLAG = "wanted_"


def entry(chunk: str) -> int:
    """The word's key: 63 bits, never ``START``."""
    word = chunk.strip(CLOSING).lower() or chunk
    digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little") >> 1 or 1


_kept = Kept(entry, 100_000)


def _pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    keys = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.view(np.uint64)
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


class Tokens:
    """A block's texts: their different keys in order, and the place of each token's among them."""

    def __init__(self, texts: list[str]) -> None:
        words, self.starts = numbered(texts, _kept)
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.starts[:-1][self.starts[:-1] < len(before)]] = START
        # Shifted, so that word keys are spread over all 64 bits as pair keys are.
        self.words, at = np.unique(np.concatenate([words, before, [START]]).astype(
            np.uint64) << np.uint64(1), return_inverse=True)
        self.word_at, self.before_at = at[:len(words)], at[len(words):-1]
        self.pairs, self.pair_at = np.unique(_pair_keys(before, words), return_inverse=True)

    def sums(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each word and pair; ``wanted`` has a flag for each text."""
        told = np.repeat(wanted, np.diff(self.starts)).astype(float)

        def pair_of(at: np.ndarray, n: int) -> list[np.ndarray]:
            return [np.bincount(at, told, n), np.bincount(at, minlength=n)]

        n = len(self.words)
        word_sums = pair_of(self.word_at, n) + pair_of(self.before_at, n)
        return (np.stack(word_sums, axis=1).astype(np.int64),
                np.stack(pair_of(self.pair_at, len(self.pairs)), axis=1).astype(np.int64))


def _packed(sums: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest needs (the first byte), lowest bytes first."""
    flat = np.ascontiguousarray(sums.T).reshape(-1)
    width = max(1, -(-int(flat.max()).bit_length() // 8)) if len(flat) else 1
    return bytes([width]) + flat.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _length(packed: bytes) -> int:
    return (len(packed) - 1) // packed[0]


def _flat(packed: bytes) -> np.ndarray:
    numbers = np.zeros((_length(packed), 8), np.uint8)
    numbers[:, :packed[0]] = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1).T
    return numbers.reshape(-1).view(np.int64)


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    return _flat(packed).reshape(width, -1).T


def _packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order, by their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_flat(packed).view(np.uint64), dtype=np.uint64)


def _blocks(docs: DataFrame, target: Column) -> DataFrame:
    """The documents in blocks, one row each (``block, chars, packed``), written."""
    kept = [f.name for f in docs.schema.fields if f.name not in ADDED]
    flagged = docs.select(*kept, F.coalesce(target, F.lit(False)).cast("boolean").alias(FLAG))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch, texts in slices(whole, "text", BLOCK_CHARS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(
                        compression="zstd")) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["block", "chars", "packed"])
                block += 1

    return written(flagged.mapInArrow(dealt, "block long, chars long, packed binary"))


def _opened(packed: bytes) -> tuple[pa.Table, Tokens]:
    table = pa.ipc.open_stream(packed).read_all()
    return table, Tokens([t or "" for t in table.column("text").to_pylist()])


def _parts(blocks: DataFrame) -> int:
    return 1 + (blocks.agg(F.sum("chars").alias("n")).first()["n"] or 0) // PART_CHARS


def _sent(blocks: DataFrame, parts: int, counts: bool, asks: bool) -> DataFrame:
    """``SENT`` of every block: with sums of 0 unless it ``counts``, as block -1, which gets no
    answer, unless it ``asks``."""
    edges = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for block, packed in zip(whole.column(0).to_pylist(), whole.column(1)):
                table, tokens = _opened(packed.as_py())
                sums = tokens.sums(table.column(FLAG).to_numpy().astype(bool))
                word_sums, pair_sums = sums if counts else (0 * sums[0], 0 * sums[1])
                w = [0, *np.searchsorted(tokens.words, edges), len(tokens.words)]
                p = [0, *np.searchsorted(tokens.pairs, edges), len(tokens.pairs)]
                rows = [(block if asks else -1, i,
                         _packed_keys(tokens.words[w[i]:w[i + 1]]),
                         _packed(word_sums[w[i]:w[i + 1]]),
                         _packed_keys(tokens.pairs[p[i]:p[i + 1]]),
                         _packed(pair_sums[p[i]:p[i + 1]]))
                        for i in range(parts) if w[i] < w[i + 1] or p[i] < p[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)

    return blocks.select("block", "packed").mapInArrow(sent, SENT)


def _summed(keys: list[bytes], sums: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """The different keys in order, their sums, and the place of each sent key among them."""
    found, at = np.unique(np.concatenate([_unpacked_keys(k) for k in keys]), return_inverse=True)
    each = [_unpacked(s, width) for s in sums]
    total = np.zeros((len(found), width), np.int64)
    for k in range(width):  # as floats, whose whole numbers are exact up to 2^53
        total[:, k] = np.bincount(at, np.concatenate([e[:, k] for e in each]), len(found))
    return found, total, at


def _columns(table: pa.Table) -> dict[str, list]:
    return {name: table.column(name).to_pylist() for name in table.column_names}


def _totals(words: np.ndarray, sums: np.ndarray) -> list[int]:
    """Words, then tokens in target and background."""
    return [int((sums[:, 1] > 0).sum()), int(sums[:, 0].sum()), int(sums[:, 1].sum())]


def _table(sent: DataFrame) -> DataFrame:
    """Each range's sums, as ``SENT`` with the range's totals."""
    def added(table: pa.Table) -> pa.Table:
        rows = _columns(table)
        words, word_sums, _ = _summed(rows["words"], rows["word_sums"], PER_WORD)
        pairs, pair_sums, _ = _summed(rows["pairs"], rows["pair_sums"], PER_PAIR)
        one = [-1, rows["part"][0], _packed_keys(words), _packed(word_sums), _packed_keys(pairs),
               _packed(pair_sums), _totals(words, word_sums)]
        return pa.table([pa.array([v], k) for v, k in zip(one, (*KINDS, TOTALS_KIND))],
                        names=[*NAMES, "totals"])

    return written(sent.groupBy("part").applyInArrow(added, f"{SENT}, totals array<long>"))


def _answers(sent: DataFrame) -> DataFrame:
    """For each block and range the sums of the keys it sent; the totals as a row of block -1."""
    def answered(table: pa.Table) -> pa.Table:
        rows = _columns(table)
        words, word_sums, word_at = _summed(rows["words"], rows["word_sums"], PER_WORD)
        _, pair_sums, pair_at = _summed(rows["pairs"], rows["pair_sums"], PER_PAIR)
        part, w, p = rows["part"][0], 0, 0
        out = [(-1, part, None, None, _totals(words, word_sums))]
        for block, its_words, its_pairs in zip(rows["block"], rows["words"], rows["pairs"]):
            first_w, first_p = w, p
            w, p = w + _length(its_words), p + _length(its_pairs)
            if block >= 0:
                out.append((block, part, _packed(word_sums[word_at[first_w:w]]),
                            _packed(pair_sums[pair_at[first_p:p]]), None))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), TOTALS_KIND)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                        names=["block", "part", "word_sums", "pair_sums", "totals"])

    return written(sent.groupBy("part").applyInArrow(answered, ANSWERED))


@dataclass
class Totals:
    """Tokens in target and background, and the vocabulary's size."""

    parts: int
    tokens: tuple[int, int]
    vocabulary: int


def _totals_of(ranges: DataFrame, parts: int) -> Totals:
    words, target, background = ranges.agg(*[F.sum(F.get("totals", F.lit(k))).alias(f"n{k}")
                                             for k in range(3)]).first()
    return Totals(parts, (target or 0, background or 0), max(WORDS, words or 0))


def train(docs: DataFrame, target: Column) -> tuple[DataFrame, Totals]:
    """The counts of documents with a ``text``, those of the target also by themselves."""
    blocks = _blocks(docs, target)
    parts = _parts(blocks)
    counts = _table(_sent(blocks, parts, counts=True, asks=False))
    release(docs.sparkSession)
    return counts, _totals_of(counts, parts)


def score(docs: DataFrame, counts: DataFrame, totals: Totals) -> DataFrame:
    """Add ``ADDED`` to documents with a ``text``."""
    blocks = _blocks(docs, F.lit(False))
    asked = _sent(blocks, totals.parts, counts=False, asks=True)
    answers = _answers(asked.unionByName(counts.drop("totals")))
    return _scored(docs, blocks, answers, totals)


def score_within(docs: DataFrame, target: Column) -> DataFrame:
    """``score`` of the documents that ``train`` counts, with one exchange of keys."""
    blocks = _blocks(docs, target)
    parts = _parts(blocks)
    answers = _answers(_sent(blocks, parts, counts=True, asks=True))
    release(docs.sparkSession)
    return _scored(docs, blocks, answers, _totals_of(answers.filter("block < 0"), parts))


def _scored(docs: DataFrame, blocks: DataFrame, answers: DataFrame, totals: Totals) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    schema = T.StructType([*kept, T.StructField(ADDED[0], T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in ADDED[1:])])

    def scored(block: pa.Table, answer: pa.Table) -> pa.Table:
        table, tokens = _opened(block.column("packed")[0].as_py())
        rows = _columns(answer.sort_by("part"))
        words = np.concatenate([_unpacked(s, PER_WORD) for s in rows["word_sums"]])
        pairs = np.concatenate([_unpacked(s, PER_PAIR) for s in rows["pair_sums"]])
        at, n = rows_of(tokens.starts), np.diff(tokens.starts)
        means = []
        for k in (0, 1):
            share = (words[:, k] + 1) / (totals.tokens[k] + totals.vocabulary)
            after = (pairs[tokens.pair_at, k] + LEAN * share[tokens.word_at]) / (
                words[tokens.before_at, 2 + k] + LEAN)
            means.append(per_row(-np.log(after), at, table.num_rows) / np.maximum(n, 1))
        values = [*means, means[0] - means[1]]
        return pa.table([*(table.column(f.name) for f in kept), pa.array(n, pa.int64()),
                         *(pa.array(v, pa.float64(), mask=n == 0) for v in values)],
                        names=[*(f.name for f in kept), *ADDED])

    return (blocks.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block"))
            .applyInArrow(scored, schema))
