"""Phrase collocations: against brute force, the schedule of counting, odd rows."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, text string"


def occurrences(docs, longest=5):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    return f, n


def brute(docs, threshold, top=2000):
    f, n = occurrences(docs)
    held = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= threshold}
    rows = {}
    for (lang, words), a in held.items():
        k = len(words)
        if any(other[0] == lang and len(other[1]) > k and 100 * c >= 100 * a
               and any(other[1][i:i + k] == words for i in range(len(other[1]) - k + 1))
               for other, c in held.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, words[:j]] * f[lang, words[j:]]), j)
                         for j in range(1, k))
        rows.setdefault(lang, []).append(
            (-score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, of in rows.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(of)[:top]))


def found(spark, docs, threshold, partitions=3, **more):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], SCHEMA)
    df = df.repartition(partitions).withColumns({"k": F.lit("x"), "n": F.lit("y")})
    return sorted(tuple(r) for r in co.collocations(df, threshold, **more).collect())


def corpus(n, seed, words=40):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]

    def text():
        out = []
        for _ in range(rng.randrange(40)):
            out.append(rng.choices([f"W{i}" if i % 3 else f"é{i}" for i in range(words)],
                                   weights)[0] if rng.random() < 0.8 else "new York  city\thall")
            out.append(rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!? "]))
        return "".join(out)

    return [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(n)]


@pytest.mark.parametrize("seed, size, shards", [(1, 300, 4), (2, 2_000_000, 4), (3, 500, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, size, shards):
    monkeypatch.setattr(co, "BLOCK_BYTES", size)
    docs = corpus(500, seed) + [("en", None), ("en", ""), ("fr", "once only")]
    assert found(spark, docs, 8, shards=shards) == brute(docs, 8)
    if seed == 1:
        assert found(spark, docs, 8, top=3) == brute(docs, 8, 3)


def test_crowded_slots_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(co, "_slots", lambda tokens, threshold: 1 << 4)
    monkeypatch.setattr(co, "BLOCK_BYTES", 400)
    docs = corpus(200, 7)
    assert found(spark, docs, 8) == brute(docs, 8)


def test_late_phrases_are_counted_for_a_whole_cycle(spark, monkeypatch):
    """A phrase whose words become frequent in the last shard's scan gets all of its count."""
    monkeypatch.setattr(co, "BLOCK_BYTES", 60)
    docs = [("en", "a b c d e f " + "x " * 24)] * 12 + [("en", "y " * 30)] * 5
    assert found(spark, docs, 12, partitions=1) == brute(docs, 12)


def test_large_numbers_are_exact(spark):
    big = 3_000_000_019
    row = spark.createDataFrame([(big, big - 7, big * 1000, big + 2)],
                                "a long, l long, n long, r long")
    text = ("div(cast(a as decimal(38,0)) * cast(n as decimal(38,0)) * cast(1000 as decimal(38,0)),"
            " cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    assert row.selectExpr(f"{text} AS x").first()["x"] == (
        1000 * big * big * 1000 // ((big - 7) * (big + 2)))


def test_phrase_ids_are_those_of_spark(spark):
    numbers = np.random.default_rng(2).integers(-2 ** 63, 2 ** 63 - 1, (50, 2))
    df = spark.createDataFrame([tuple(map(int, r)) for r in numbers], "a long, b long")
    mine = co.phrase_ids(*numbers.T.copy().view(np.uint64)).view(np.int64).tolist()
    assert [r[0] for r in df.select(F.xxhash64("a", "b")).collect()] == mine


def test_parts_end_between_pieces():
    text = "A b. c d,e\nf gg hhh iiii" * 3
    parts = list(co.parts_of(text, 7))
    assert b"\n".join(parts) == next(co.parts_of(text)) and len(parts) > 5
    assert list(co.parts_of("word " * 10, 7)) == [b"word " * 10]


def test_empty_tables_and_texts(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(None, None), ("en", " \t")], 1) == []


def test_one_long_text_with_one_phrase(spark):
    docs = [("en", "again and " * 60_000)]
    f, n = occurrences(docs)
    rows = found(spark, docs, 100)
    assert rows == brute(docs, 100) and {r[6] for r in rows} == {120_000} == set(n.values())


def test_blocks_hold_places_that_read_back_as_ids():
    parts = [b"b a  b\nc a", b"\n", b"", b"d b"]
    places, sums, words = co._block(parts)
    ids, keys, n = co._read("en", places, sums, words)
    known = dict(zip(words.split(b"\n"), keys.tolist()))
    want = [known.get(w, 0) for w in b"\n".join(parts).replace(b"\n", b" \n ").split()]
    lines = [[known[w] for w in line.split()] for line in b"\n".join(parts).split(b"\n")]
    assert [i for i in ids.tolist() if i] == want == [i for line in lines for i in line]
    assert np.flatnonzero(ids == 0).tolist() == [3, 6, 7, 8, 9] and len(places) == 2 * len(ids)
    assert dict(zip(known, n.tolist())) == {b"b": 3, b"a": 2, b"c": 1, b"d": 1}
    many = b" ".join(b"w%d" % i for i in range(70_000))
    ids, keys, n = co._read("en", *co._block([many]))
    assert ids.tolist() == keys.tolist() == co._keys("en", many.split(b" ")).tolist()
    assert co._read("en", *co._block([b"\n"]))[0].tolist() == [0]


def test_tables_sent_to_tasks_go_with_their_scan(spark, monkeypatch):
    """Each scan sends tables of its own; their files must not pile up until the end."""
    made = []
    scan = co._scan
    monkeypatch.setattr(co, "_scan", lambda blocks, at, shared, *more: (
        made.append(shared), scan(blocks, at, shared, *more))[1])
    docs = corpus(200, 7)
    assert found(spark, docs, 8) == brute(docs, 8)
    assert len(made) > 4 and all(shared._jbroadcast is not None for shared in made)
    assert not any(os.path.exists(shared._path) for shared in made)


@pytest.mark.parametrize("held", [1, 8])
def test_many_languages_share_the_space_of_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(co, "BLOCK_BYTES", 300)
    monkeypatch.setattr(co, "HELD", held)
    docs = [(f"l{i % 30}", text) for i, (_, text) in enumerate(corpus(300, 5))]
    assert found(spark, docs, 8) == brute(docs, 8)
