"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades.

Grades are ordered, 0 (none) to ``GRADES`` - 1. All thresholds share one weight vector w,

    P(grade > j) = sigmoid(w . x - t_j),   t_0 < t_1 < ...,

and the expected severity is the sum of these probabilities over j.

Features are hashed words (lower case, marks around them cut off) with the logarithm of their
count. Only words that speak for toxicity get a feature: among the labelled documents they stand
in toxic ones in at least ``MIN_CONTEXTS`` different contexts (the word before; copies of one
document give one context), mostly in toxic ones, and more often than chance by a likelihood ratio. Labels
say toxic or not; a toxic document's grade comes from how often such words occur in it, cut at
fixed counts.

Fitting uses at most ``SAMPLE`` labelled documents taken by a hash of their ids, up to
half of them toxic; word numbers are all the driver sees of them. Where a class has more documents
than are taken of it, each one taken stands for several: weights, from a count of all labels, bring
the classes back to their natural shares in the choice of words, the weights and the thresholds. Scoring is one pass without a shuffle; the weights have
a fixed size and are broadcast.

Defined cases: a null text counts as empty and gets the severity of a text without such words;
texts are read whole; repeated rows get equal results; without toxic labels nothing is toxic;
other columns stay, and the added ones replace any of the same name. No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.batches import Kept, numbered, per_row, rows_of, slices
from corpuslens.llm.samples import class_counts, labelled_sample

SAMPLE = 20_000
BITS = 20
SIZE = 1 << BITS
MIN_CONTEXTS, MIN_GAIN, MIN_SHARE = 4, 18.0, 0.6
# A toxic document has grade 1, and one more for each of these counts of telling words it reaches.
GRADE_COUNTS = (3, 6)
GRADES = 2 + len(GRADE_COUNTS)
AROUND = ".,;:!?\"'()[]{}<>*_-~`"
ADDED = ("expected_severity", "severity", "toxic", "p_toxic")


def word_bin(chunk: str) -> int:
    word = chunk.strip(AROUND).casefold() or chunk
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (SIZE - 1)


_kept = Kept(word_bin)


@dataclass
class Ordinal:
    """``slot`` gives each bin its weight's place, or -1; ``thresholds`` ascend."""

    slot: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        numbers, starts = numbered(texts, _kept)
        slots = self.slot[numbers]
        told = slots >= 0
        return self.weighted(rows_of(starts)[told], slots[told], len(texts))

    def weighted(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        keys, counts = np.unique(rows * len(self.weights) + slots, return_counts=True)
        rows, slots = keys // max(1, len(self.weights)), keys % max(1, len(self.weights))
        return per_row(self.weights[slots] * np.log1p(counts), rows, n)

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds, -30, 30)))


def row_weights(toxic: np.ndarray, stands_for: tuple[float, float]) -> np.ndarray:
    """Each row's weight, 1 on average, so that the classes have their natural shares."""
    weights = np.where(toxic == 1, stands_for[1], stands_for[0])
    return weights * (len(weights) / max(weights.sum(), 1e-9))


def telling_words(rows: np.ndarray, words: np.ndarray, before: np.ndarray,
                  toxic: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Bins of words that speak for toxicity; ``stands_for``: labelled documents to each clean and
    each toxic one that was taken. Evidence is that of as many documents as were taken."""
    if not len(words):
        return np.zeros(0, np.int64)
    keys = np.unique(np.stack([rows, words], axis=1), axis=0)
    weights = row_weights(toxic, stands_for)
    in_toxic = np.bincount(keys[:, 1], (toxic * weights)[keys[:, 0]], SIZE)
    in_clean = np.bincount(keys[:, 1], ((1 - toxic) * weights)[keys[:, 0]], SIZE)
    rate = (toxic * weights).sum() / len(toxic)
    seen = in_toxic + in_clean
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(in_toxic > 0, in_toxic * np.log(in_toxic / (seen * rate)), 0)
                    + np.where(in_clean > 0, in_clean * np.log(in_clean / (seen * (1 - rate))), 0))
    mine = toxic[rows] == 1
    contexts = np.unique(np.stack([words[mine], before[mine]], axis=1), axis=0)
    n_contexts = np.bincount(contexts[:, 0], minlength=SIZE)
    return np.flatnonzero((n_contexts >= MIN_CONTEXTS) & (gain >= MIN_GAIN)
                          & (in_toxic > MIN_SHARE * seen))


def fit(rows: np.ndarray, words: np.ndarray, before: np.ndarray, toxic: np.ndarray,
        steps: int = 400, rate: float = 0.2, decay: float = 1e-5,
        stands_for: tuple[float, float] = (1.0, 1.0)) -> Ordinal:
    """Gradient descent (Adam) on the cumulative-link likelihood; thresholds are kept apart."""
    n = len(toxic)
    chosen = telling_words(rows, words, before, toxic, stands_for)
    weights = row_weights(toxic, stands_for)
    slot = np.full(SIZE, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    told = slot[words] >= 0 if len(words) else np.zeros(0, bool)
    r, s = rows[told], slot[words[told]].astype(np.int64)
    occurrences = np.bincount(r, minlength=n)
    grade = np.where(toxic == 1, 1 + sum((occurrences >= c).astype(int) for c in GRADE_COUNTS), 0)
    links = GRADES - 1
    model = Ordinal(slot, np.zeros(len(chosen)), np.linspace(3.0, 4.0 + links, links))
    if not toxic.sum():
        model.thresholds = np.full(links, 30.0)
        return model
    keys, counts = np.unique(r * max(1, len(chosen)) + s, return_counts=True)
    r, s, x = keys // max(1, len(chosen)), keys % max(1, len(chosen)), np.log1p(counts)
    # Parameters: weights, the first threshold, and logarithms of the gaps between thresholds.
    theta = np.concatenate([np.full(len(chosen), 1.0), [3.0], np.zeros(links - 1)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    share = 1.0 / n

    def unpack(t: np.ndarray) -> None:
        model.weights = t[:len(chosen)]
        model.thresholds = t[len(chosen)] + np.concatenate([[0], np.cumsum(np.exp(
            t[len(chosen) + 1:]))])

    for step in range(1, steps + 1):
        unpack(theta)
        margins = np.bincount(r, model.weights[s] * x, n) if len(chosen) else np.zeros(n)
        above = model.above(margins)
        # d/d margin of -log P(grade): the grade's probability is a difference of two links.
        upper = np.concatenate([np.ones((n, 1)), above], axis=1)
        lower = np.concatenate([above, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(upper[at, grade] - lower[at, grade], 1e-9)
        slope = above * (1 - above)
        g_link = np.zeros((n, links))
        inside = grade > 0
        g_link[at[inside], grade[inside] - 1] -= slope[at[inside], grade[inside] - 1] / p[inside]
        inside = grade < links
        g_link[at[inside], grade[inside]] += slope[at[inside], grade[inside]] / p[inside]
        g_link *= weights[:, None]
        g_margin, g_threshold = g_link.sum(axis=1), -g_link.sum(axis=0) * share
        g_weights = (np.bincount(s, g_margin[r] * x, len(chosen)) * share + decay * model.weights
                     if len(chosen) else np.zeros(0))
        gaps = np.exp(theta[len(chosen) + 1:])
        g_gaps = np.array([g_threshold[j + 1:].sum() for j in range(links - 1)]) * gaps
        gradient = np.concatenate([g_weights, [g_threshold.sum()], g_gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        theta = theta - rate * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    unpack(theta)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """A model fitted to ``labels`` (``doc_id, toxic``) on at most ``sample`` documents."""
    chosen = labelled_sample(docs, labels, "toxic", sample, even=True).select("doc_id", "label", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                numbers, starts = numbered(texts, _kept)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(
                        np.split(numbers.astype(np.int32), starts[1:-1]), pa.list_(pa.int32()))],
                    names=["doc_id", "label", "words"])

    found = chosen.mapInArrow(rows, "doc_id long, label int, words array<int>").toArrow()
    column = found.column("words").combine_chunks()
    sizes = column.value_lengths().to_numpy() if found.num_rows else np.zeros(0, np.int64)
    words = column.flatten().to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts[:-1][starts[:-1] < len(before)]] = -1
    toxic = (found.column("label").to_numpy() > 0).astype(float)
    n_toxic, n_clean = class_counts(labels, "toxic")
    return fit(rows_of(starts), words, before, toxic, stands_for=(
        max(1.0, n_clean / max(1, sample // 2)), max(1.0, n_toxic / max(1, sample // 2))))


def grade_documents(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Add ``expected_severity``, ``severity`` (the likeliest grade), ``toxic`` and ``p_toxic``
    to documents with a ``text``; ``toxic`` is a probability of a grade above 0 of 0.5 or more."""
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                above = shared.value.above(shared.value.margins(texts))
                edge = np.ones((len(texts), 1))
                each = np.concatenate([edge, above], axis=1) - np.concatenate(
                    [above, 0 * edge], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(above.sum(axis=1)),
                     pa.array(each.argmax(axis=1), pa.int64()), pa.array(above[:, 0] >= 0.5),
                     pa.array(above[:, 0])],
                    names=[*batch.schema.names, *ADDED])

    types = (T.DoubleType(), T.LongType(), T.BooleanType(), T.DoubleType())
    schema = T.StructType([*kept, *(T.StructField(c, t) for c, t in zip(ADDED, types))])
    return docs.select(*[f.name for f in kept]).mapInArrow(graded, schema)
