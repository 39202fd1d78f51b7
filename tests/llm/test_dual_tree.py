"""Ranked lexical search: against brute force, pruning, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import dual_tree as dt

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMAS = ("doc_id long, text string", "item_id long, text string")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        scores = []
        for d, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scores.append((-score, -1 if d is None else d))
        out += [(item, r + 1, None if d == -1 else d, -s)
                for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **more):
    found = dt.rank_documents(
        spark.createDataFrame(docs, SCHEMAS[0]).repartition(3)
        .withColumns({"score": F.lit("old"), "ids": F.lit(2), "row_": F.lit(None)}),
        spark.createDataFrame(items, SCHEMAS[1]).withColumn("term", F.lit(1)), **more)
    return sorted(map(tuple, found.collect()), key=str)


def corpus(n, seed, words=300, length=60):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(f"W{w}x" for w in rng.choices(range(words), weights,
                                                       k=rng.randrange(1, length))))
            for i in range(n)]


def test_terms_of_a_text():
    text = "ÀB.c-1_2 Ünï\x00x\x7fÉa ß日[本]'S"
    assert [t.decode() for t in dt.terms_of(text)] == terms(text)
    assert dt.terms_of(None) == [] == dt.terms_of(" .-")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(dt, "LEAF", 4)
    monkeypatch.setattr(dt, "FAN", 2)
    monkeypatch.setattr(dt, "SEED_SHARE", 4)
    docs = corpus(400, seed) + [(1000, None), (1001, ""), (1002, "-- ..")]
    items = corpus(23, seed + 10, length=15) + [(90, None), (91, "nowhere found")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, docs, items, k=3) == brute(docs, items, 3)


def test_batches_of_items_give_the_same_rows(spark):
    docs, items = corpus(120, 5), corpus(12, 6, length=10)
    assert ranked(spark, docs, items, batch_terms=20) == brute(docs, items)


def test_ties_copies_and_repeated_ids(spark):
    copies = [(i, "alpha beta gamma") for i in range(40, 0, -1)]
    docs = copies + [(None, "alpha beta gamma"), (50, "alpha"), (50, "alpha"), (51, "other")]
    items = [(1, "alpha"), (1, "BETA beta"), (2, "alpha"), (None, "other"), (3, "Other!")]
    got = ranked(spark, docs, items)
    assert got == brute(docs, items)
    assert [r[2] for r in sorted(got, key=lambda r: (str(r[0]), r[1])) if r[0] == 1] == [
        None, *range(1, 10)]


def test_a_very_long_text(spark):
    docs = corpus(30, 3) + [(99, "W1x " * 300_000 + "rare")]
    items = [(1, "rare W1x"), (2, "W2x " * 50_000)]
    assert ranked(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []),
                                         ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert ranked(spark, docs, items) == []


def _bundle(vectors):
    starts = np.cumsum([0, *map(len, vectors)])
    ids = np.array([t for v in vectors for t in sorted(v)], np.int32)
    return dt.Bundle(starts, ids, np.array([v[t] for v in vectors for t in sorted(v)], np.int32))


def test_bounds_hold_and_whole_batches_go():
    rng = random.Random(4)
    # Two halves without common terms: an item of one half never opens the other half's nodes.
    vectors = [{(0 if d < 512 else 50) + rng.randrange(50): rng.randrange(1, 900)
                for _ in range(6)} for d in range(1024)]
    items = [np.array(sorted(rng.sample(range(50 * (i // 8), 50 * (i // 8) + 50), 5)), np.int32)
             for i in range(16)]
    weights = [1000 - t for t in range(100)]
    bundle = _bundle(vectors)
    search = dt.Search(items, weights, [0] * 16)
    nodes, pairs = [bundle.root], []
    while nodes:
        node = nodes.pop()
        nodes += node.children
        pairs.append(node)
    exact = [[sum(weights[t] * v.get(t, 0) for t in item.tolist()) for v in vectors]
             for item in items]
    leaves, stack = {}, [search.root]
    while stack:
        node = stack.pop()
        stack += node.children
        if node.item >= 0:
            leaves[node.item] = node
    for item, node in leaves.items():
        for docs in pairs:
            assert search.bound(node, docs) >= max(exact[item][docs.start:docs.end])
    search.add(bundle, list(range(1024)), list(range(1024)))
    assert search.scored <= 16 * 1024 / 2 and search.pruned > 0
    for item in range(16):
        best = sorted(((s, -d) for d, s in enumerate(exact[item]) if s > 0), reverse=True)[:10]
        assert sorted(((s, d) for s, d, _ in search.best[item]), reverse=True) == best
