"""Ranked lexical search of all documents for a table of items, by a dual-tree traversal.

Terms are the runs of letters, digits and characters beyond ASCII in a whole text, with A-Z in
lower case. With N documents that hold a term, L terms in all of them, n terms in one, df documents
with a term and tf occurrences of it in a document,

    w = floor(1000 ln((2N + 2) / (2 df + 1))),   m = 10 + (90 n N) div L,
    c = (10^9 tf) div (1000 tf + 8 m),           score = sum of w c over the item's terms.

1. Items become rows ``item_id, term``, and are dealt into batches of about ``BATCH_TERMS`` such
   rows, so that a batch may be broadcast; each batch reads the texts once.
2. A document becomes a vector over the batch's terms, numbered by falling weight, and the vectors
   are sorted by their rarest terms, in ranges. Equal vectors are parted by their row number, so no
   group of copies fills a range.
3. A task takes ``BUNDLE`` neighbouring documents at a time and builds a tree over them, whose
   nodes hold the largest c of each term below. A tree over the items, sorted in the same way, holds
   the terms of the items below each node and the least of their weakest kth scores.
4. A pair of nodes has the bound ``sum of w max c`` over the terms of the item node. If it is below
   the items' least kth score, no pair of their items and documents can matter, and the whole batch
   goes; otherwise the taller node is opened, documents with the highest bound first. A pair with
   an equal bound stays, as a smaller ``doc_id`` wins a tie.
5. The same traversal over one row in ``SEED_SHARE`` gives each item a lower bound of its kth
   score; the traversal of all rows starts from it. So what tasks return stays near
   ``k * SEED_SHARE`` rows an item, whatever the size, and Spark ranks these.

All bounds and scores are integers, so nothing is lost or rounded.

Defined cases: a null or empty text has no terms and ranks nowhere; rows of one ``item_id`` are one
item, whose terms are those of all of them; an item without terms, or with none that occurs, has no
rows; rows with one ``doc_id`` rank each by itself, and a null id before all others; texts are
read whole; other columns are left out. No documents or no items give no rows.
"""

from __future__ import annotations

import heapq
import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.text import written

K = 10
BATCH_TERMS = 200_000
BUNDLE, LEAF, FAN = 8192, 32, 8
ITEM_FAN = 4
SEED_SHARE = 64
ROWS_PER_RANGE = 16_384
LEAST = -1 << 63
LETTERS = (string.ascii_letters + string.digits).encode()
#: Each byte of a text as it counts in a term, or a blank.
BYTES = bytes(b if b > 127 else (ord(chr(b).lower()) if b in LETTERS else 32) for b in range(256))
VECTOR = "row_ long, doc_id long, n long, ids array<int>, tfs array<int>"
IMPACTS = "row_ long, doc_id long, ids array<int>, cs array<int>"
FOUND = "item int, doc_id long, row_ long, score long"
RANKED = ("item_id", "rank", "doc_id", "score")


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` of items ``item_id, text``, each once; a term as its bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = set(terms_of(text.as_py()))
                ids += [item_id] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.binary())],
                names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        rows, "item_id long, term binary").distinct()


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``VECTOR`` of the documents that hold any term: their length, and what they hold of the
    vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            kept, sizes, ids, tfs = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                terms = terms_of(text.as_py())
                if terms:
                    held, tf = np.unique(np.fromiter(
                        (t for t in map(number, terms) if t is not None), np.int32),
                        return_counts=True)
                    kept.append(i)
                    sizes.append(len(terms))
                    ids.append(held)
                    tfs.append(tf)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())),
                 batch.column(1).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 _lists(ids), _lists(tfs)],
                names=[c.split()[0] for c in VECTOR.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row_"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, VECTOR)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impacts(table: DataFrame, ranks: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``IMPACTS``: each document's c by term number in the order of weight (``ranks``: the new
    number of each term, -1 if it weighs nothing)."""
    shared = table.sparkSession.sparkContext.broadcast(ranks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            at, ids, cs = [], [], []
            sizes, all_ids, all_tfs = (batch.column(i) for i in (2, 3, 4))
            for i, n in enumerate(sizes.to_pylist()):
                held = ranks[all_ids[i].values.to_numpy()]
                order = np.argsort(held, kind="stable")[int((held < 0).sum()):]
                if len(order):
                    tf = all_tfs[i].values.to_numpy()[order].astype(np.int64)
                    m = 10 + 90 * n * n_docs // n_terms
                    at.append(i)
                    ids.append(held[order])
                    cs.append(1_000_000_000 * tf // (1000 * tf + 8 * m))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), _lists(ids), _lists(cs)],
                names=["row_", "doc_id", "ids", "cs"])

    return table.mapInArrow(rows, IMPACTS)


# Trees --------------------------------------------------------------------------------------

@dataclass(slots=True)
class ItemNode:
    """Items below one node: their terms with weights, and the least of their kth scores."""

    terms: list[tuple[int, int]]
    floor: int = 1
    children: list[ItemNode] = field(default_factory=list)
    parent: ItemNode | None = None
    item: int = -1
    height: int = 0

    def raised(self) -> None:
        """Carry a raised floor upwards."""
        node = self.parent
        while node is not None:
            least = min(child.floor for child in node.children)
            if least == node.floor:
                return
            node.floor = least
            node = node.parent


def item_tree(items: list[np.ndarray], weights: list[int], floors: list[int]) -> ItemNode:
    """A tree over items, given as sorted term numbers; neighbours share their rarest terms."""
    order = sorted(range(len(items)), key=lambda i: items[i].tolist())
    level = [ItemNode([(t, weights[t]) for t in items[i].tolist()], floors[i], item=i)
             for i in order]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), ITEM_FAN):
            children = level[start:start + ITEM_FAN]
            node = ItemNode(sorted(set().union(*(c.terms for c in children))),
                            min(c.floor for c in children), children,
                            height=1 + children[0].height)
            for child in children:
                child.parent = node
            above.append(node)
        level = above
    return level[0]


@dataclass(slots=True)
class DocNode:
    """Documents ``start`` to ``end`` of a bundle: the largest c of each term among them."""

    largest: dict[int, int]
    start: int
    end: int
    children: list[DocNode] = field(default_factory=list)
    height: int = 0


class Bundle:
    """Neighbouring documents and the tree over them."""

    def __init__(self, starts: np.ndarray, ids: np.ndarray, cs: np.ndarray) -> None:
        self.n = len(starts) - 1
        self.ids, self.cs, self.starts = ids, cs.astype(np.int64), starts
        doc = np.repeat(np.arange(self.n), np.diff(starts))
        level, width = self._level(doc // LEAF, ids, self.cs, None), LEAF
        while len(level) > 1:
            width *= FAN
            level = self._level(doc // width, ids, self.cs, level)
        self.root = level[0]
        self.postings: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}

    def _level(self, group: np.ndarray, ids: np.ndarray, cs: np.ndarray,
               below: list[DocNode] | None) -> list[DocNode]:
        keys = group.astype(np.int64) << 32 | ids
        order = np.argsort(keys, kind="stable")
        keys, cs = keys[order], cs[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        largest = np.maximum.reduceat(cs, first)
        at = keys[first]
        edges = np.searchsorted(at >> 32, np.arange(int(group[-1]) + 2))
        terms, largest = (at & 0xFFFFFFFF).tolist(), largest.tolist()
        nodes = []
        for g in range(int(group[-1]) + 1):
            held = dict(zip(terms[edges[g]:edges[g + 1]], largest[edges[g]:edges[g + 1]]))
            if below is None:
                nodes.append(DocNode(held, g * LEAF, min(self.n, (g + 1) * LEAF)))
            else:
                children = below[g * FAN:(g + 1) * FAN]
                nodes.append(DocNode(held, children[0].start, children[-1].end, children,
                                     1 + children[0].height))
        return nodes

    def scores(self, leaf: DocNode, terms: list[tuple[int, int]]) -> np.ndarray:
        """The scores of a leaf's documents for one item."""
        held = self.postings.get(leaf.start)
        if held is None:
            low, high = self.starts[leaf.start], self.starts[leaf.end]
            doc = np.repeat(np.arange(leaf.end - leaf.start),
                            np.diff(self.starts[leaf.start:leaf.end + 1]))
            order = np.argsort(self.ids[low:high], kind="stable")
            ids, doc, cs = self.ids[low:high][order], doc[order], self.cs[low:high][order]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            ends = [*first[1:].tolist(), len(ids)]
            held = {t: (doc[a:b], cs[a:b])
                    for t, a, b in zip(ids[first].tolist(), first.tolist(), ends)}
            self.postings[leaf.start] = held
        total = np.zeros(leaf.end - leaf.start, np.int64)
        for term, w in terms:
            if term in held:
                doc, cs = held[term]
                total[doc] += w * cs
        return total


class Search:
    """The best ``k`` documents of every item, over bundles."""

    def __init__(self, items: list[np.ndarray], weights: list[int], floors: list[int],
                 k: int = K) -> None:
        self.k, self.best = k, [[] for _ in items]
        self.root = item_tree(items, weights, [max(1, f) for f in floors]) if items else None
        self.pairs = self.pruned = self.scored = 0

    @staticmethod
    def bound(items: ItemNode, docs: DocNode) -> int:
        largest = docs.largest.get
        return sum([w * largest(t, 0) for t, w in items.terms])

    def add(self, bundle: Bundle, doc_ids: list[int], rows: list[int]) -> None:
        if self.root is not None and bundle.n:
            self._visit(self.root, bundle.root, self.bound(self.root, bundle.root), bundle,
                        doc_ids, rows)

    def _visit(self, items: ItemNode, docs: DocNode, bound: int, bundle: Bundle,
               doc_ids: list[int], rows: list[int]) -> None:
        self.pairs += 1
        if bound < items.floor:
            self.pruned += 1
        elif items.children and items.height >= docs.height:
            for child in items.children:
                self._visit(child, docs, self.bound(child, docs), bundle, doc_ids, rows)
        elif docs.children:
            bounds = sorted(((self.bound(items, d), -i) for i, d in enumerate(docs.children)),
                            reverse=True)
            for reach, i in bounds:
                self._visit(items, docs.children[-i], reach, bundle, doc_ids, rows)
        elif items.children:
            for child in items.children:
                self._visit(child, docs, self.bound(child, docs), bundle, doc_ids, rows)
        else:
            self._score(items, docs, bundle, doc_ids, rows)

    def _score(self, items: ItemNode, docs: DocNode, bundle: Bundle, doc_ids: list[int],
               rows: list[int]) -> None:
        scores = bundle.scores(docs, items.terms)
        self.scored += len(scores)
        heap = self.best[items.item]
        for i in np.flatnonzero(scores >= items.floor).tolist():
            at = docs.start + i
            entry = (int(scores[i]), -doc_ids[at], -rows[at])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k and heap[0][0] > items.floor:
            items.floor = heap[0][0]
            items.raised()

    def found(self) -> Iterator[tuple[int, int | None, int, int]]:
        for item, heap in enumerate(self.best):
            for score, doc_id, row in heap:
                yield item, None if -doc_id == LEAST else -doc_id, -row, score


def _traversed(table: DataFrame, items: list[np.ndarray], weights: list[int],
               floors: list[int], k: int) -> DataFrame:
    """``FOUND``: each task's best rows, none below an item's floor."""
    shared = table.sparkSession.sparkContext.broadcast((items, weights, floors))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, n = Search(*shared.value, k), [], 0

        def flush() -> None:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            for batch in whole:
                ids, cs = batch.column(2), batch.column(3)
                starts = ids.offsets.to_numpy().astype(np.int64)
                first, last = starts[0], starts[-1]
                search.add(
                    Bundle(starts - first, ids.values.to_numpy()[first:last],
                           cs.values.to_numpy()[first:last]),
                    [LEAST if d is None else d for d in batch.column(1).to_pylist()],
                    batch.column(0).to_pylist())

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BUNDLE - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == BUNDLE:
                    flush()
                    held, n = [], 0
        if n:
            flush()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*search.found())) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                         names=["item", "doc_id", "row_", "score"])

    return table.mapInArrow(rows, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The rank of the best ``k`` of each item; Spark keeps only k an item in each task before it
    shuffles."""
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row_")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ranked_batch(docs: DataFrame, entries: pa.Table, k: int) -> DataFrame:
    """``RANKED`` for one batch of items."""
    spark = docs.sparkSession
    item_ids = entries.column("item_id").to_pylist()
    names = sorted(set(item_ids), key=lambda i: LEAST if i is None else i)
    terms = entries.column("term").to_pylist()
    vocabulary = {t: n for n, t in enumerate(sorted(set(terms)))}
    table = written(vectors(docs, vocabulary))
    n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
    counts = table.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts.column("id").to_numpy()] = counts.column("count").to_numpy()
    weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)
    order = np.lexsort((np.arange(len(df)), -weights))
    used = order[weights[order] > 0]
    ranks = np.full(len(df), -1, np.int32)
    ranks[used] = np.arange(len(used))

    numbers = {name: n for n, name in enumerate(names)}
    held: list[list[int]] = [[] for _ in names]
    for item_id, term in zip(item_ids, terms):
        if ranks[vocabulary[term]] >= 0:
            held[numbers[item_id]].append(ranks[vocabulary[term]])
    items = [np.array(sorted(h), np.int32) for h in held]
    ranges = 1 + (n_docs or 0) // ROWS_PER_RANGE
    impacts = _impacts(table, ranks, n_docs or 0, n_terms or 1)
    rarest = [F.get("ids", F.lit(i)) for i in range(4)]
    sorted_ = written(impacts.repartitionByRange(ranges, *rarest, "row_")
                      .sortWithinPartitions(*rarest, "row_"))
    each = weights[used].tolist()
    seeds = _best(_traversed(sorted_.filter(F.pmod(F.xxhash64("row_"), F.lit(SEED_SHARE)) == 0),
                             items, each, [0] * len(items), k), k)
    floors = [0] * len(items)
    for row in seeds.filter(F.col("rank") == k).select("item", "score").toArrow().to_pylist():
        floors[row["item"]] = row["score"]
    ranked = _best(_traversed(sorted_, items, each, floors, k), k)
    named = spark.createDataFrame(pa.table(
        {"item": pa.array(range(len(names)), pa.int32()), "item_id": pa.array(names, pa.int64())}))
    return ranked.join(F.broadcast(named), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K,
                   batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``RANKED``: the best ``k`` documents ``doc_id, text`` of each item ``item_id, text``."""
    entries = written(item_terms(items))
    total = entries.count()
    batches = 1 + total // batch_terms
    parts = []
    for batch in range(batches if total else 0):
        mine = entries.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == batch).toArrow()
        if mine.num_rows:
            parts.append(_ranked_batch(docs, mine, k))
    if not parts:
        return docs.sparkSession.createDataFrame(
            [], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
