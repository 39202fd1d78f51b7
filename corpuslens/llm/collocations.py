"""Phrase collocations of each language, counted by dynamic itemset counting.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at
blanks and tabs. A phrase of 2 to 5 words within a piece counts with all its occurrences f; those
with ``f >= THRESHOLD`` are candidates. A cut after its first words gives l = f(first part),
r = f(rest) and ``floor(1000 a n / (l r))`` with a = f(phrase) and n words of the language; the
lowest cut is the score. A candidate inside a longer one with the same f is dropped.

**Counting.** Texts become arrays of words once, as places in a block's list of words, and the blocks
are dealt into ``SHARDS`` shards that are scanned in turn, again and again. Words are counted from
the start. A phrase is counted from the scan after which both of its subphrases (without its last,
and without its first word) have been seen ``THRESHOLD`` times, and for one full cycle: every shard
once. So lengths are interleaved: the pairs of frequent words are counted while rarer words are still
being counted, and longer phrases follow at once. As f never grows with length, every candidate's parts are counted too. The scans end
when nothing has reached the threshold for a whole cycle.

**What moves.** A scan sends partial sums of the phrases that are being counted, and Spark adds them
to the phrases under way, the only table that is carried along; a phrase leaves it after its cycle.
A phrase is known by the ids of its two subphrases, so counts of length k need only what is known of
length k - 1. Tasks must know when a subphrase reached the threshold: tables of one byte (the
scan's number) for each slot of a hash, at most ``MOST_SLOTS`` for each length, are broadcast. Two
phrases in one slot share the earlier number. That may count a phrase that need not be, or from an
earlier scan, always the same one, and never before all that it is made of can be seen; its cycle is
complete all the same, so no count is changed.

Word ids are 64-bit hashes of language and word. Results are exact unless two of the words or
subphrases that reach the threshold have equal hashes (chance about 1e-7 at a million of them).

Defined cases: a null text counts as empty; a null language is ``und``; repeated rows count each;
texts are read whole, in parts that end between pieces; other columns are left out; a language with
fewer phrases has fewer rows. No rows give no rows.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.text import release, written
from corpuslens.operators.bounded import shared_folder

THRESHOLD = 100
LONGEST = 5
TOP = 2000
SHARDS = 4
BLOCK_BYTES = 2_000_000
HELD = 8
MOST_SLOTS = 1 << 25
NEVER = 255
NO_LANGUAGE = "und"
MARKS = b".,;:!?\n\x0b\x0c\r"
UPPER = string.ascii_uppercase.encode()
#: Each byte of a text: small letters, a line feed between pieces, a blank between words.
BYTES = bytes(b + 32 if b in UPPER else 10 if b in MARKS else 32 if b == 9 else b
              for b in range(256))
BLOCKS = "shard int, lang string, places binary, sums binary, words binary"
COUNTS = "k byte, a long, b long, n long, start byte"
# The constants of the 64-bit xxHash.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _hashed(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    h = (seed + P5 + np.uint64(8)) ^ (_turned(x * P2, 31) * P1)
    h = _turned(h, 27) * P1 + P4
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def phrase_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``xxhash64(a, b)`` is in Spark, for unsigned numbers of the same bits."""
    with np.errstate(over="ignore"):
        return _hashed(b, _hashed(a, np.uint64(42)))


def parts_of(text: str | None, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text's bytes as they count, in parts of about ``size`` that end between pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(BYTES)
    start = 0
    while len(data) - start > size:
        end = data.rfind(b"\n", start, start + size)
        if end < 0:
            end = data.find(b"\n", start + size)
        if end < 0:
            break
        yield data[start:end]
        start = end + 1
    if start < len(data):
        yield data[start:]


def _keys(lang: str, words: list[bytes]) -> np.ndarray:
    """The ids of words of a language; never 0."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in words), np.uint64, len(words))


def _places(words: int) -> str:
    """The type of a word's place among so many, from 1; 0 stands between pieces."""
    return "<u2" if words < 1 << 16 else "<u4"


def _block(parts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Each word's place among the different ones (0 between pieces), how often each of these
    occurs, and the words. Places take a fraction of the space of ids, which are hashes."""
    tokens = b"\n".join(parts).replace(b"\n", b" \n ").split(b" ")
    places: dict[bytes, int] = {b"": 0, b"\n": 1}
    for token in tokens:
        places.setdefault(token, len(places))
    at = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
    words = list(places)[2:]
    order = (at[at > 0] - 1).astype(_places(len(words)))
    sums = np.bincount(at, minlength=len(places))[2:]
    return order.tobytes(), sums.astype("<i8").tobytes(), b"\n".join(words)


def _read(lang: str, places: bytes, sums: bytes, words: bytes) -> tuple[np.ndarray, ...]:
    """A block's word ids in order (0 between pieces); the ids of its different words, and how
    often each occurs."""
    n = np.frombuffer(sums, "<i8")
    keys = _keys(lang, words.split(b"\n") if len(n) else [])
    order = np.frombuffer(places, _places(len(n)))
    return np.concatenate([np.zeros(1, np.uint64), keys])[order], keys, n


def word_blocks(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``BLOCKS`` of documents ``lang, text``, a folder for each shard."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, sizes = TaskContext.get().partitionId(), {}, {}

        def flush(langs: list[str]) -> pa.RecordBatch:
            sizes.update(dict.fromkeys(langs, 0))
            made = [(number % shards, lang, *_block(held.pop(lang))) for lang in langs]
            kinds = (pa.int32(), pa.string(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*made), kinds)],
                names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in parts_of(text.as_py()):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    # One language fills a block, so that its words are listed once; many
                    # languages share the space of a few.
                    if sizes[lang] >= BLOCK_BYTES or sum(sizes.values()) >= HELD * BLOCK_BYTES:
                        yield flush([lang] if sizes[lang] >= BLOCK_BYTES else list(held))
                        number += 1
        if held:
            yield flush(list(held))

    known = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return written(known.mapInArrow(rows, BLOCKS), "shard")


def _slots(tokens: int, threshold: int) -> int:
    """No more than ``tokens / threshold`` phrases of one length can be candidates; a table has
    four slots for each, as long as it may."""
    return min(MOST_SLOTS, 1 << max(16, (4 * tokens // threshold).bit_length()))


def _scan(blocks: DataFrame, scan: int, shared: Broadcast, shards: int,
          longest: int) -> DataFrame:
    """``COUNTS`` of one shard: what is being counted in this scan, block by block."""
    words_too = scan <= shards

    def phrases(ids: np.ndarray, steps: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        at = np.flatnonzero(ids)
        h, since = ids[at], np.zeros(len(at), np.uint8)
        for k in range(2, longest + 1):
            step = steps[k - 2]
            reached = step[(h & np.uint64(len(step) - 1)).astype(np.int64)]
            near = np.flatnonzero((np.diff(at) == 1) & (reached[:-1] < NEVER)
                                  & (reached[1:] < NEVER))
            if not len(near):
                return
            reached = np.maximum(reached, since)
            start = np.maximum(reached[near], reached[near + 1])
            a, b = h[near], h[near + 1]
            both = phrase_ids(a, b)
            live = np.flatnonzero(start.astype(np.int64) + shards >= scan)
            if len(live):
                _, first, n = np.unique(both[live], return_index=True, return_counts=True)
                one = live[first]
                yield np.full(len(one), k, np.int8), a[one], b[one], n, start[one]
            at, h, since = at[near], both, start

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys, sums = _read(*(column[i].as_py() for column in batch.columns))
                found = list(phrases(ids, steps))
                if words_too:
                    zeros = np.zeros(len(keys), np.uint64)
                    found.append((zeros.astype(np.int8) + np.int8(1), keys, zeros, sums, zeros))
                if found:
                    k, a, b, n, start = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, pa.int8()), pa.array(a.astype(np.uint64).view(np.int64)),
                         pa.array(b.astype(np.uint64).view(np.int64)),
                         pa.array(n.astype(np.int64)), pa.array(start.astype(np.int8))],
                        names=[c.split()[0] for c in COUNTS.split(", ")])

    shard = blocks.filter(F.col("shard") == (scan - 1) % shards)
    return shard.select("lang", "places", "sums", "words").mapInArrow(rows, COUNTS)


def _id(k: Column, a: Column, b: Column) -> Column:
    return F.when(k == 1, a).otherwise(F.xxhash64(a, b))


def _reached(counts: DataFrame, slots: int, longest: int) -> list[dict]:
    """The slots of what has just reached the threshold, as bits: rows of at most 4 KB, whose
    number is bounded by the slots."""
    slot = _id(F.col("k"), F.col("a"), F.col("b")).bitwiseAND(F.lit(slots - 1)) + 1
    return (counts.filter(F.col("k") < longest).select("k", slot.alias("slot"))
            .groupBy("k", F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
            .toArrow().to_pylist())


def _saved(df: DataFrame, place: str, mode: str = "error") -> DataFrame:
    df.write.mode(mode).option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def frequent_phrases(blocks: DataFrame, tokens: int, threshold: int = THRESHOLD,
                     longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, np.ndarray]:
    """``k, a, b, n`` of all phrases of up to ``longest`` words with ``n >= threshold``, and the
    table of words that reached it."""
    slots = _slots(tokens, threshold)
    steps = [np.full(slots, NEVER, np.uint8) for _ in range(longest - 1)]
    spark = blocks.sparkSession
    folder = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    under_way, scan, last = None, 0, 0
    while scan < last + shards:
        scan += 1
        shared = spark.sparkContext.broadcast(steps)
        found = _scan(blocks, scan, shared, shards, longest).withColumn("before", F.lit(0))
        if under_way is not None:
            found = found.unionByName(under_way.withColumn("before", F.col("n")))
        counts = _saved(found.groupBy("k", "a", "b").agg(
            F.sum("n").alias("n"), F.min("start").alias("start"),
            F.sum("before").alias("before")), f"{folder}/scan-{scan}")
        # Each scan has tables of its own; without this their files stay on the driver and on all
        # executors until the end. What was counted with them is written.
        shared.destroy(blocking=True)
        for row in _reached(counts.filter((F.col("n") >= threshold)
                                          & (F.col("before") < threshold)), slots, longest):
            begin = (row["bucket"] - 1) << 15
            step = steps[row["k"] - 1][begin:begin + (1 << 15)]
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
            step[(bits[:len(step)] > 0) & (step == NEVER)] = scan
            last = scan
        over = F.col("start") + shards <= scan
        _saved(counts.filter(over & (F.col("n") >= threshold)).select("k", "a", "b", "n"),
               f"{folder}/complete", "append")
        under_way = counts.filter(~over).select("k", "a", "b", "n", "start")
        # Only the last table of what is under way is read again; the one before goes, and so do
        # the shuffle files that made it.
        if scan > 1:
            store.delete_dir(f"{root}/scan-{scan - 1}")
        release(spark)
    found = spark.read.schema("k byte, a long, b long, n long").parquet(f"{folder}/complete")
    return found, steps[0]


def _words(blocks: DataFrame, step: np.ndarray) -> DataFrame:
    """``id, lang, word`` of the words that reached the threshold."""
    shared = blocks.sparkSession.sparkContext.broadcast(step)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for batch in batches:
            for lang, words in zip(*(batch.column(i).to_pylist() for i in range(2))):
                found = words.split(b"\n") if words else []
                keys = _keys(lang, found)
                at = np.flatnonzero(step[(keys & np.uint64(len(step) - 1)).astype(np.int64)]
                                    < NEVER)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at].view(np.int64)), pa.array([lang] * len(at), pa.string()),
                     pa.array([found[i].decode("utf-8", "replace") for i in at.tolist()],
                              pa.string())], names=["id", "lang", "word"])

    return (blocks.select("lang", "words").mapInArrow(
        rows, "id long, lang string, word string").distinct()
        .groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word")))


def _longer(phrases: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of one length with what their two subphrases know."""
    first = shorter.select(F.col("id").alias("a"), F.col("f").alias("fa"), "lang",
                           F.col("text").alias("text_a"), F.col("lefts").alias("lefts_a"))
    rest = shorter.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("last"),
                          F.col("rights").alias("rights_b"))
    return phrases.join(first, "a").join(rest, "b").select(
        F.xxhash64("a", "b").alias("id"), F.col("n").alias("f"), "a", "b", "fa", "fb", "lang",
        F.concat_ws(" ", "text_a", "last").alias("text"), "last",
        F.concat("lefts_a", F.array("fa")).alias("lefts"),
        F.concat(F.array("fb"), "rights_b").alias("rights"))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST,
                 top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of documents ``lang, text``."""
    blocks = word_blocks(docs, shards)
    totals = written(blocks.select("lang", "sums").mapInArrow(_totals, "lang string, n long")
                     .groupBy("lang").agg(F.sum("n").alias("n")))
    tokens = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    found, step = frequent_phrases(blocks, tokens, threshold, longest, shards)
    none = F.array().cast("array<bigint>")
    level = written(found.filter("k = 1").select(F.col("a").alias("id"), F.col("n").alias("f"))
                    .join(_words(blocks, step), "id").select(
        "id", "f", "lang", F.col("word").alias("text"), F.col("word").alias("last"),
        none.alias("lefts"), none.alias("rights")))
    levels = []
    for k in range(2, longest + 1):
        level = written(_longer(found.filter(F.col("k") == k).select("a", "b", "n"), level))
        levels.append(level)
    kept = []
    for level, longer in zip(levels, [*levels[1:], None]):
        if longer is not None:  # inside any longer one means inside one that is longer by a word
            held = longer.filter("f = fa").select(F.col("a").alias("id")).union(
                longer.filter("f = fb").select(F.col("b").alias("id"))).distinct()
            level = level.join(held, "id", "left_anti")
        kept.append(level.select("lang", "text", "f", "lefts", "rights"))

    def big(x: Column) -> Column:
        return x.cast("decimal(38,0)")

    def score(left: Column, i: Column) -> Column:
        product = big(left) * big(F.get("rights", i))
        return F.struct(F.call_function("div", big(F.col("f")) * big(F.col("n")) * big(F.lit(1000)),
                                        product).alias("score"), i.alias("cut"))

    scored = reduce(DataFrame.unionByName, kept).join(totals, "lang").withColumn(
        "best", F.array_min(F.transform("lefts", score)))
    cut = F.col("best.cut")
    rows = scored.select(
        "lang", F.col("text").alias("phrase"), F.col("f").alias("a"),
        F.get("lefts", cut).alias("l"), F.get("rights", cut).alias("r"), "n",
        F.col("best.score").cast("long").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(s, "<i8").sum()) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())],
                                         names=["lang", "n"])
