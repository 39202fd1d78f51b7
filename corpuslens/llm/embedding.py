"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label link when their cosine is ``similarity`` or more, that is, when the
normalised vectors are within ``eps = sqrt(2 - 2 similarity)``. They are projected on the leading
principal directions of a bounded sample (any orthonormal directions give valid lower bounds, so
the sample only affects speed), sorted by their cells in a grid of width ``eps``, and cut into
sequence blocks of ``BLOCK`` vectors. Pairs of blocks whose boxes come within ``eps`` are joined;
a task halves both sequences again and again, drops parts whose boxes are too far apart, and
compares the rest by matrix products in double precision.

A block pair yields a count for each vector that has links and one edge for each vector that is
not the smallest of what is connected there: no row for a pair, so a group of thousands of copies
costs its products only. Counts are summed, edges go to ``components``.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
those without label, have no links; vectors of different lengths have none; of rows with equal
``vec_id`` the smallest by label and vector counts; a null ``vec_id`` gets a row without links;
other columns are left out. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.components import components
from corpuslens.operators.bounded import checkpointed

SIMILARITY = 0.93
SAMPLE = 4_000
DIRECTIONS = 6
BLOCK = 512
LEAF = 128
# Rounding of a sum of products in double precision, for what is dropped unseen.
GUARD = 1e-9
BLOCKS = ("block long, label int, width int, low array<double>, high array<double>, "
          "ids binary, places binary, vectors binary")


def principal_directions(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each vector length, orthonormal leading directions of a sample taken by hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    by_width: dict[int, list] = {}
    for row in rows.column("v").to_pylist():
        by_width.setdefault(len(row), []).append(row)
    found = {}
    for width, members in by_width.items():
        x = np.array(members, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found[width] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :DIRECTIONS]
    return found


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> DataFrame:
    """One row ``vec_id, label, v`` for each id, ``v`` null where the vector cannot link."""
    once = vectors.groupBy("vec_id").agg(F.min(F.struct(
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"))).alias("r"))
    v = F.col("r.v")
    finite = F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = (F.col("vec_id").isNotNull() & F.col("r.label").isNotNull() & finite
              & F.exists(v, lambda x: x != 0))
    return once.select("vec_id", "r.label", F.when(usable, v).alias("v"))


def ordered_blocks(vectors: DataFrame, directions: dict[int, np.ndarray], eps: float,
                   block: int = BLOCK) -> DataFrame:
    """Vectors in epsilon grid order, cut into ``BLOCKS``."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            places: list = [None] * len(rows)
            for width in {len(r) for r in rows}:
                mine = [i for i, r in enumerate(rows) if len(r) == width]
                basis = directions.get(width, np.eye(width)[:, :DIRECTIONS])
                for i, p in zip(mine, _unit([rows[i] for i in mine]) @ basis):
                    places[i] = p.tolist()
            cells = [[int(np.floor(x / eps)) for x in p] for p in places]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(map(len, rows), pa.int32()),
                 pa.array(places, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32()))],
                names=["vec_id", "label", "v", "width", "place", "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            places = np.array([r["place"] for r in held], float)
            row = [number, held[0]["label"], held[0]["width"], places.min(axis=0).tolist(),
                   places.max(axis=0).tolist(),
                   np.array([r["vec_id"] for r in held], np.int64).tobytes(), places.tobytes(),
                   _unit([r["v"] for r in held]).tobytes()]
            number += 1
            held.clear()
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()),
                     pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types)],
                names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                kind = (row["label"], row["width"])
                if held and (len(held) >= block or kind != (held[0]["label"], held[0]["width"])):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    rows = vectors.mapInArrow(placed, "vec_id long, label int, v array<double>, width int, "
                                      "place array<double>, cells array<int>")
    order = ["label", "width", "cells", "vec_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, BLOCKS)


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``a, b`` with a <= b: blocks of one label whose boxes come within ``eps``."""
    light = blocks.select("block", "label", "width", "low", "high")

    def strips(margin: float) -> F.Column:
        return F.explode(F.sequence(
            F.floor((F.get("low", F.lit(0)) - margin) / eps),
            F.floor((F.get("high", F.lit(0)) + margin) / eps))).alias("strip")

    left = light.select("*", strips(0.0)).select(
        "label", "width", "strip", F.struct("block", "low", "high").alias("x"))
    right = light.select("*", strips(eps * 1.001)).select(
        "label", "width", "strip", F.struct("block", "low", "high").alias("y"))
    gaps = F.aggregate(F.zip_with(
        F.zip_with("x.low", "y.high", lambda p, q: p - q),
        F.zip_with("y.low", "x.high", lambda p, q: p - q),
        lambda p, q: F.greatest(p, q, F.lit(0.0))),
        F.lit(0.0), lambda total, gap: total + gap * gap)
    return (left.join(right, ["label", "width", "strip"])
            .filter((F.col("x.block") <= F.col("y.block")) & (gaps <= eps * eps + GUARD))
            .select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct())


def _box_gap(p: np.ndarray, q: np.ndarray) -> float:
    gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
    return float((gap ** 2).sum())


def linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray,
           similarity: float, eps: float, leaf: int = LEAF) -> np.ndarray:
    """Which rows of x and y link, found by halving both sequences."""
    mask = np.zeros((len(x), len(y)), bool)
    pending = [(0, len(x), 0, len(y))]
    while pending:
        i, m, j, n = pending.pop()
        if _box_gap(px[i:m], py[j:n]) > eps * eps + GUARD:
            continue
        if max(m - i, n - j) <= leaf:
            mask[i:m, j:n] = x[i:m] @ y[j:n].T >= similarity
            continue
        rows = [(i, m)] if m - i <= leaf else [(i, (i + m) // 2), ((i + m) // 2, m)]
        columns = [(j, n)] if n - j <= leaf else [(j, (j + n) // 2), ((j + n) // 2, n)]
        pending += [(*r, *c) for r in rows for c in columns]
    return mask


def join_blocks(blocks: DataFrame, pairs: DataFrame, similarity: float, eps: float) -> DataFrame:
    """``vec_id, n, smallest``: links found in a block pair, and the smallest id connected there."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, places, vectors = [], [], []
                for side in "ab":
                    n = len(row[f"{side}_ids"]) // 8
                    ids.append(np.frombuffer(row[f"{side}_ids"], np.int64))
                    places.append(np.frombuffer(row[f"{side}_places"]).reshape(n, -1))
                    vectors.append(np.frombuffer(row[f"{side}_vectors"]).reshape(n, -1))
                mask = linked(*vectors, *places, similarity, eps)
                if row["a"] == row["b"]:
                    np.fill_diagonal(mask, False)
                counts = [mask.sum(axis=1), mask.sum(axis=0)]
                labels = [i.copy() for i in ids]
                far = np.iinfo(np.int64).max
                while mask.any():  # the smallest id spreads along the links
                    one = np.minimum(labels[0], np.where(mask, labels[1], far).min(axis=1))
                    two = np.minimum(labels[1], np.where(mask.T, one, far).min(axis=1))
                    if row["a"] == row["b"]:
                        one = two = np.minimum(one, two)
                    if (one == labels[0]).all() and (two == labels[1]).all():
                        break
                    labels = [one, two]
                for k in (0,) if row["a"] == row["b"] else (0, 1):
                    some = counts[k] > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[k][some]), pa.array(counts[k][some].astype(np.int64)),
                         pa.array(labels[k][some])], names=["vec_id", "n", "smallest"])

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("block").alias(name), *[
            F.col(c).alias(f"{name}_{c}") for c in ("ids", "places", "vectors")])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(
        joined, "vec_id long, n long, smallest long")


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY,
                 block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for vectors ``vec_id, label, embedding``."""
    eps = float(np.sqrt(2 - 2 * similarity))
    rows = checkpointed(_usable(vectors))
    usable = rows.filter(F.col("v").isNotNull())
    blocks = checkpointed(ordered_blocks(usable, principal_directions(usable), eps, block))
    pairs = checkpointed(block_pairs(blocks, eps))
    found = checkpointed(join_blocks(blocks, pairs, similarity, eps))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    edges = found.select(F.col("smallest").alias("a"), F.col("vec_id").alias("b"))
    groups = components(edges).withColumnRenamed("node", "vec_id")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(counts, "vec_id", "left").join(
        groups, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
