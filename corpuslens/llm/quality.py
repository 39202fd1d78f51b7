"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text becomes a sparse row: hashed words (by logarithmic count, unit length), hashed word shapes
(by share), and one bin for each statistic of its structure and of its declared length. The score
is a logistic factorisation machine,

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so that all pairs of features interact through vectors of low rank at a cost linear in the row.

Fitting uses at most ``SAMPLE`` labelled documents, taken by a hash of their ids; their rows of
numbers are what the driver sees. The fitted weights have a fixed size and are broadcast.
Scoring is one pass over the documents, without a shuffle.

Defined cases: a null text counts as empty, has no words and is scored by its statistics; a null
or missing declared length is a bin of its own; texts are read whole; repeated rows get the same
score; other columns stay, and the added ones replace any of the same name. No rows give no rows.
Without labels of both kinds every score is the share of ones (0.5 without any label).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.batches import Kept, numbered, per_row, rows_of, slices
from corpuslens.llm.samples import labelled_sample

SAMPLE = 8_000
WORD_BITS, SHAPE_BITS, RANK = 18, 12, 4
BINS = 16
REJECT_BELOW = 0.3
STATISTICS = ("log words", "words a line", "word length", "upper", "digit", "mark", "bar",
              "beyond ascii", "distinct", "repeated", "commonest", "declared length")
WORDS, SHAPES = 1 << WORD_BITS, 1 << SHAPE_BITS
SIZE = WORDS + SHAPES + len(STATISTICS) * BINS
# Classes of bytes: upper, lower, digit, bar, white space, other ASCII, beyond ASCII.
CLASSES = np.array([
    0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b == 124
    else 4 if b in b" \t\r\n\x0b\x0c" else 5 if b < 128 else 6 for b in range(256)], np.uint8)
_SHAPE = [(re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"),
          (re.compile("[0-9]+"), "0")]


def _number(chunk: str) -> int:
    """Bins of a chunk's word and of its shape (kinds of characters, runs as one)."""
    shape = chunk
    for kind, mark in _SHAPE:
        shape = kind.sub(mark, shape)
    word = zlib.crc32(chunk.encode("utf-8", "surrogatepass"))
    form = zlib.crc32(b"shape" + shape.encode("utf-8", "surrogatepass"))
    return (word & (WORDS - 1)) | (form & (SHAPES - 1)) << 32


_kept = Kept(_number)


def _grouped(rows: np.ndarray, bins: np.ndarray, bits: int):
    """Distinct (row, bin) pairs and how often each occurs."""
    keys, counts = np.unique(rows << bits | bins, return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), counts


def _binned(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bins 1 to 15 of equal width; 0 is kept for a missing value."""
    place = (np.clip(values, low, high) - low) / (high - low)
    return 1 + np.minimum((place * (BINS - 1)).astype(np.int64), BINS - 2)


def features(texts: list[str], lengths: list[int | None]) -> tuple[np.ndarray, ...]:
    """Sparse rows as ``(row, feature, value)``, ordered by row."""
    n = len(texts)
    numbers, starts = numbered(texts, _kept)
    rows, total = rows_of(starts), np.diff(starts)
    words, shapes = numbers & (WORDS - 1), numbers >> 32
    w_row, w_bin, w_count = _grouped(rows, words, WORD_BITS)
    w_value = np.log1p(w_count)
    w_value /= np.sqrt(per_row(w_value ** 2, w_row, n))[w_row]
    s_row, s_bin, s_count = _grouped(rows, shapes, SHAPE_BITS)
    s_value = s_count / total[s_row]

    kinds = np.zeros((n, 7))
    lines = np.zeros(n)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        kinds[i] = np.bincount(CLASSES[raw], minlength=7)
        lines[i] = 1 + np.count_nonzero(raw == 10)
    chars = np.maximum(kinds.sum(axis=1), 1)
    some = np.maximum(total, 1)
    same = np.zeros(len(numbers))
    same[1:] = (numbers[1:] == numbers[:-1]) & (rows[1:] == rows[:-1])
    commonest = np.zeros(n)
    np.maximum.at(commonest, w_row, w_count)
    declared = np.array([-1.0 if x is None else np.log2(1 + max(x, 0)) for x in lengths])
    statistics = [
        _binned(np.log2(1 + total), 0, 16), _binned(np.log2(1 + total / lines), 0, 12),
        _binned((chars - kinds[:, 4]) / some, 0, 15), _binned(kinds[:, 0] / chars, 0, 1),
        _binned(kinds[:, 2] / chars, 0, 0.3), _binned(kinds[:, 5] / chars, 0, 0.6),
        _binned(kinds[:, 3] / chars, 0, 0.15), _binned(kinds[:, 6] / chars, 0, 0.6),
        _binned(np.bincount(w_row, minlength=n) / some, 0, 1),
        _binned(per_row(same, rows, n) / some, 0, 1), _binned(commonest / some, 0, 1),
        np.where(declared < 0, 0, _binned(declared, 0, 24)),
    ]
    z_row = np.tile(np.arange(n), len(statistics))
    z_bin = np.concatenate([WORDS + SHAPES + k * BINS + b for k, b in enumerate(statistics)])
    row = np.concatenate([w_row, s_row, z_row])
    order = np.argsort(row, kind="stable")
    feature = np.concatenate([w_bin, WORDS + s_bin, z_bin])
    value = np.concatenate([w_value, s_value, np.full(len(z_row), 0.5)])
    return row[order], feature[order].astype(np.int64), value[order]


@dataclass
class Machine:
    """Weights: ``bias``, ``linear`` (one a feature) and ``factors`` (``RANK`` a feature)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, row, feature, value, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins by row, and the sums of the factors by row."""
        scaled = self.factors[feature] * value[:, None]
        sums = per_row(scaled, row, n)
        squares = per_row((scaled ** 2).sum(axis=1), row, n)
        linear = per_row(self.linear[feature] * value, row, n)
        return self.bias + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def scores(self, row, feature, value, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(row, feature, value, n)[0], -30, 30)))


def fit(row, feature, value, labels: np.ndarray, epochs: int = 8, batch: int = 64,
        rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Adaptive gradient descent on the logistic loss; the rows come in the order of learning."""
    n = len(labels)
    share = float(np.mean(labels)) if n else 0.5
    start = np.random.default_rng(7).normal(0, 0.01, (SIZE, RANK)).astype(np.float32)
    if share in (0.0, 1.0) or not n:
        bias = 0.0 if not n else float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Machine(bias, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))
    model = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32), start)
    seen_linear, seen_factors, seen_bias = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    edges = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs):
        for first in range(0, n, batch):
            last = min(n, first + batch)
            part = slice(edges[first], edges[last])
            r, f, x = row[part] - first, feature[part], value[part]
            margin, sums = model.margins(r, f, x, last - first)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[first:last]
            used, place = np.unique(f, return_inverse=True)
            step = error[r] * x
            g = np.bincount(place, step, len(used)) / batch + decay * model.linear[used]
            seen_linear[used] += g ** 2
            model.linear[used] -= rate * g / np.sqrt(seen_linear[used])
            own = model.factors[f] * x[:, None]
            gv = per_row(step[:, None] * (sums[r] - own), place, len(used)) / batch
            gv += decay * model.factors[used]
            seen_factors[used] += gv ** 2
            model.factors[used] -= rate * 0.3 * gv / np.sqrt(seen_factors[used])
            gb = float(np.mean(error))
            seen_bias += gb ** 2
            model.bias -= rate * gb / np.sqrt(seen_bias)
    return model


def _lengths(batch: pa.RecordBatch, column: str | None) -> list[int | None]:
    if column is None:
        return [None] * batch.num_rows
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted to ``labels`` (``doc_id, quality``) on at most ``sample`` documents."""
    declared = "n_chars" if "n_chars" in docs.columns else None
    chosen = labelled_sample(docs, labels, "quality", sample).select(
        "doc_id", "label", F.col("text").cast("string"),
        *([F.col("n_chars").cast("long")] if declared else []))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                row, feature, value = features(texts, _lengths(batch, declared))
                edges = np.searchsorted(row, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1),
                    pa.array(np.split(feature.astype(np.int32), edges[1:-1]), pa.list_(pa.int32())),
                    pa.array(np.split(value.astype(np.float32), edges[1:-1]),
                             pa.list_(pa.float32()))], names=["doc_id", "label", "f", "x"])

    found = chosen.mapInArrow(
        rows, "doc_id long, label int, f array<int>, x array<float>").toArrow()
    ids = found.column("doc_id").to_numpy()
    mixed = np.argsort(ids * np.int64(-7046029254386353131), kind="stable")  # order of learning
    found = found.take(pa.array(mixed)).combine_chunks()
    if not found.num_rows:
        return fit(*[np.zeros(0, np.int64)] * 3, np.zeros(0))
    sizes = found.column("f").combine_chunks().value_lengths().to_numpy()
    flat = [found.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            for c in ("f", "x")]
    return fit(np.repeat(np.arange(len(sizes)), sizes), flat[0].astype(np.int64),
               flat[1].astype(np.float64), found.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """Add ``score``, the probability of good quality, to documents with a ``text``."""
    kept = [f for f in docs.schema.fields if f.name != "score"]
    declared = "n_chars" if "n_chars" in docs.columns else None
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                row, feature, value = features(texts, _lengths(batch, declared))
                found = weights.value.scores(row, feature, value, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found, pa.float64())],
                    names=[*batch.schema.names, "score"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    return docs.select(*[f.name for f in kept]).mapInArrow(scored, schema)
