"""Token ids in files: codes against brute force, round trips, odd rows."""

import heapq
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import token_files as tf
from corpuslens.llm.queries import queries

SF = "/root/testdata/sf0.001"
NASTY = ["", None, " ", "  ", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n  b\t c", "it's we'll  I'd",
         "x<|endoftext|> y", "日本 語", "é é", "a\x1c b", "\x85 \xa0z", "😀 😀😀", "w" * 5000,
         "1234 5,6.7", "!?' '!", "a.\nB, c;"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tf.TOKENIZER)


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(5)
    letters = " \n\t\r'sabE1.,\x1c\x85\xa0　 éß日!-́"
    texts = NASTY + ["".join(rng.choice(letters) for _ in range(rng.randrange(25)))
                     for _ in range(4000)]
    encode = tf.ByteEncoder(kept=50)
    ids, starts = encode.ids([t or "" for t in texts], [tf.END_ID])
    for text, start, end in zip(texts, starts, starts[1:]):
        assert ids[start:end].tolist() == [*tokenizer.encode(
            text or "", add_special_tokens=False).ids, tf.END_ID]
    assert [len(a) for a in encode.ids([], [2])] == [0, 1]


def _huffman_cost(counts):
    heap, cost = sorted(c for c in counts if c), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_code_lengths_are_the_best_within_the_limit():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = rng.integers(0, 60, 6) ** 2
        n = int((counts > 0).sum())
        if n < 2:
            continue
        for limit in (3, 4):
            best = min(sum(c * b for c, b in zip(counts[counts > 0], bits))
                       for bits in itertools.product(range(1, limit + 1), repeat=n)
                       if sum(2.0 ** -b for b in bits) <= 1)
            assert int((tf.code_lengths(counts, limit) * counts).sum()) == best
    counts = rng.zipf(1.2, 3000)
    assert int((tf.code_lengths(counts, 50) * counts).sum()) == _huffman_cost(counts.tolist())
    assert tf.code_lengths(counts, 12).max() <= 12
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(17, int), 4)


def test_codes_are_canonical_and_prefix_free():
    lengths = tf.code_lengths(np.array([5, 0, 1, 1, 9, 2, 2]))
    words = [format(int(c), f"0{n}b") for c, n in zip(tf.codes(lengths), lengths) if n]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    order = tf.canonical(lengths)
    assert [int(s) for s in order] == sorted(order, key=lambda s: (lengths[s], s))
    numbers = [int(tf.codes(lengths)[s]) << (20 - int(lengths[s])) for s in order]
    assert numbers == sorted(numbers)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 1000])
@pytest.mark.parametrize("symbols", [1, 2, 300])
def test_bits_round_trip(n, symbols):
    ids = np.random.default_rng(n).integers(0, symbols, n) ** 2 // max(1, symbols)
    lengths = tf.code_lengths(np.bincount(ids, minlength=symbols))
    words, offsets = tf.pack_bits(ids, lengths, tf.codes(lengths), block=16)
    assert len(offsets) == -(-n // 16)
    assert (tf.unpack_bits(words, offsets, n, lengths, block=16) == ids).all()


def test_a_block_is_read_by_its_checkpoint_alone():
    ids = np.random.default_rng(1).zipf(1.4, 5000) % 200
    lengths = tf.code_lengths(np.bincount(ids))
    words, offsets = tf.pack_bits(ids, lengths, tf.codes(lengths), block=64)
    assert (tf.unpack_bits(words, offsets[7:8], 64, lengths, block=64)
            == ids[7 * 64:8 * 64]).all()


def test_a_damaged_segment_is_refused():
    ids = np.array([1, 2, 2, 3])
    lengths = tf.code_lengths(np.bincount(ids))
    data = tf._segment([4, None], [1, 3], ids, lengths, tf.codes(lengths))
    doc_ids, counts, read = tf.read_segment(data)
    assert (doc_ids, counts.tolist(), read.tolist()) == ([4, None], [1, 3], ids.tolist())
    with pytest.raises(ValueError):
        tf.read_segment(data[:-2] + b"\xff\xff")
    with pytest.raises(ValueError):
        tf.read_segment(b"nothing at all")


def _expected(tokenizer, rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, tf.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids, segment_ids", [(tf.FILE_IDS, tf.SEGMENT_IDS), (700, 100)])
def test_files_hold_all_ids_in_order(spark, tokenizer, tmp_path, file_ids, segment_ids):
    rows = [(7 * i % 101, text) for i, text in enumerate(NASTY)] + [(None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) \
        .withColumns({"start": F.lit("old"), "ids": F.lit(1)})
    files = tf.write_ids(docs, folder=str(tmp_path / "ids"), file_ids=file_ids,
                         segment_ids=segment_ids)
    reopened = tf.open_ids(spark, files.folder)
    got = [tuple(r) for r in tf.read_ids(reopened).collect()]
    rows.sort(key=lambda r: -1 if r[0] is None else r[0])
    assert sorted(got, key=lambda r: r[1]) == _expected(tokenizer, rows)
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist()
           for r in tf.read_ids(reopened, ids=True).collect()}
    assert ids[7] == [tf.END_ID] and tokenizer.decode(ids[7 * 18 % 101][:-1]) == NASTY[18]
    assert (reopened.manifest.count() > 2) == (segment_ids == 100)


def test_rows_of_one_id_follow_each_other(spark, tokenizer):
    docs = spark.createDataFrame([(1, "one"), (2, "b c"), (2, "b c"), (2, "more of it"),
                                  (3, "z")], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"])
                 for r in tf.read_ids(tf.write_ids(docs)).collect())
    assert [g[1] for g in got] == [1, 2, 2, 2, 3]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


def test_no_rows_give_no_rows(spark):
    files = tf.write_ids(spark.createDataFrame([], "doc_id long, text string"))
    assert tf.read_ids(files).count() == 0 and files.manifest.count() == 0


def test_query_equals_brute_force(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r) for r in queries()["op11_token_files"](spark, SF).collect()]
    assert sorted(got) == sorted(_expected(tokenizer, rows))
