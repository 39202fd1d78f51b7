"""Operators over texts: brute force, round trips, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import chat, components, decontaminate, jaccard, licences, lm, packing
from corpuslens.llm.licence_texts import LICENCES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# Licences -----------------------------------------------------------------------------------

def test_licence_survives_case_punctuation_copyright_and_spelling(spark):
    mit = next(t for name, t in LICENCES if name == "MIT")
    changed = ("Copyright (c) 2020 Someone\nAll rights reserved.\n\n"
               + mit.upper().replace(",", " ;").replace("SUBLICENSE", "sub-license"))
    wrapped = " ".join(mit.split()).replace("software", "Software")
    rows = [(1, mit), (2, changed), (3, wrapped), (4, mit + " and more"), (5, None), (6, ""),
            (7, "Prose.\nRELEASED under the MIT licence!\nReleased under the MIT License."),
            (1, mit)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("license", F.lit("old"))
    found = licences.scan_licences(docs, licences.known_digests(spark)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    assert [by_id[i]["license"] for i in (1, 2, 3)] == ["MIT"] * 3
    assert [by_id[i]["license"] for i in (4, 5, 6, 7)] == [None] * 4
    assert by_id[7]["notices"] == ["MIT"] and by_id[7]["n_notices"] == 2
    assert by_id[5]["text_digest"] == by_id[6]["text_digest"] == hashlib.sha256(b"").hexdigest()


def test_copyright_holder_lines_of_a_licence_stay(spark, column):
    lines = column(licences.canonical_lines(F.lit(
        "Copyright 2001 A\ncopyright holder or contributors be liable\n(c) 1999 B\n © 2003 C")))
    assert lines == ["copyright holder or contributors be liable"]


def test_licences_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert licences.scan_licences(empty, licences.known_digests(spark)).count() == 0


# Chat ---------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\", "<\\/s>", "[ROLE]x[TEXT]y[/ROLE]", "", None,
         "[\\INST]", "<s><</s>", "a\nb", "[INST[INST]]", "é [OUT]"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "[OUT]"]),
             rng.choice(NASTY)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "x"), (7, None, "user", "null turn"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df.withColumn("segments", F.lit(1)))
    read = made.select("conv_id", "segments", "formatted",
                       chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("segments")).alias("loss")).collect()
    wanted = {}
    for c, t, role, text in rows:
        wanted.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(read) == len(wanted)
    for r in read:
        turns = [(role, text) for _, role, text in sorted(wanted[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])


def test_turn_order(spark):
    said = {1: ["system", "user", "assistant", "user"], 2: ["user", "user"], 3: ["assistant"],
            4: ["user", "assistant", "system"], 5: ["user", "tool"]}
    rows = [(c, i, role, "x") for c, roles in said.items() for i, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["valid"], r["bad_turn"])
             for r in chat.format_conversations(df).collect()}
    assert found == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, 2), 5: (False, 1)}
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("opens, closes", [("[A]", "[A]"), ("x", "[B]"), ("a\\b", "[B]")])
def test_marks_that_cannot_be_read_back_are_refused(opens, closes):
    with pytest.raises(ValueError):
        chat.Template((chat.Role("user", opens, closes, False, ()),)).controls()


# Near duplicates ----------------------------------------------------------------------------

def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family_texts():
    """Families of near copies around the threshold, a passage that many share, short texts."""
    rng = random.Random(11)
    texts, passage = {}, words(60, 999, 10_000)
    for family, (length, copies) in enumerate([(300, 30), (40, 25), (12, 12), (1500, 6)]):
        first = words(length, family, 10_000)
        for _ in range(copies):
            w = list(first)
            for _ in range(rng.randrange(0, max(2, length // 22))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            texts[len(texts)] = " ".join(w[:rng.randrange(int(length * 0.8), length + 1)])
    for i in range(60):
        own = words(rng.randrange(0, 160), 5000 + i, 10_000)
        texts[len(texts)] = " ".join(own + passage)
    for text in ("", None, " \t\n", "one", "One", "one two three four", "one two three four five",
                 "É b c d e", "é b c d e", "a b c d e f", "a\x1cb c d e f"):
        texts[len(texts)] = text
    for n in range(1, 40):
        for _ in range(3):
            w = words(n, n, 30)
            w[rng.randrange(n)] = f"y{rng.randrange(3)}"
            texts[len(texts)] = " ".join(w)
    return texts


@pytest.mark.parametrize("fetched", [0, 1000])
def test_jaccard_equals_brute_force(spark, monkeypatch, fetched):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "FETCHED", fetched)
    texts = family_texts()
    docs = spark.createDataFrame(list(texts.items()) + [(0, texts[0])], DOCS)
    docs = docs.withColumn("key", F.lit(1)).withColumn("size", F.lit("x"))
    found = jaccard.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == (
        brute_components(texts))
    assert len(found) == len(texts)


def test_sets_that_link_share_a_signature():
    rng = np.random.default_rng(3)
    for size in [1, 2, 3, 4, 5, 7, 8, 15, 16, 21, 63, 64, 85, 128, 300, 1000]:
        for _ in range(20):
            a = rng.integers(0, 2 ** 64, size, np.uint64)
            gone, come = (int(rng.integers(0, size // 3 + 1)) for _ in range(2))
            b = np.concatenate([a[gone:], rng.integers(0, 2 ** 64, come, np.uint64)])
            if not len(b) or 100 * (size - gone) < 75 * (size + come):
                continue
            made = jaccard.signatures([np.sort(a), np.sort(b)])
            met = {}
            for which, instance, spare, sigs in made:
                met.setdefault(instance, {})[which] = spare, set(sigs.tolist())
            both = [list(m.values()) for m in met.values() if len(m) == 2]
            assert any(len(x & y) >= max(1, p, q) for (p, x), (q, y) in both), size


def test_sets_apart_share_few_signatures():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2 ** 64, 60, np.uint64)
    a, b = (np.sort(np.concatenate([shared, rng.integers(0, 2 ** 64, 400, np.uint64)]))
            for _ in range(2))
    made = jaccard.signatures([a, b])
    sigs = [np.concatenate([s for w, _, _, s in made if w == i]) for i in range(2)]
    assert len(np.intersect1d(*sigs)) < len(sigs[0]) / 50


def test_block_pairs_are_dealt_by_pair_of_blocks(spark):
    members = spark.createDataFrame(
        [], "place long, key long, component long, size int, sketch array<bigint>")
    plan = jaccard._block_pairs(members)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [place" in plan.replace("#", " ").replace("  ", " ")
    assert plan.count("RepartitionByExpression") == 2


def test_buckets_that_batches_cut(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, 3, rng.randrange(4, 60)]), rng.randrange(20), jaccard.tag(8, -3))
            for _ in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        met = jaccard._met(spark.createDataFrame(
            rows, "sig long, key long, tag long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    buckets = {}
    for sig, key, *_ in rows:
        buckets.setdefault(sig, set()).add(key)
    large = sorted((s, k) for s, keys in buckets.items() if len(keys) > jaccard.FEW for k in keys)
    pairs = sorted((a, b) for keys in buckets.values() if len(keys) <= jaccard.FEW
                   for a in keys for b in keys if a < b)
    assert large and pairs
    assert {(r["instance"], r["spare"]) for r in met} == {(8, -3)}
    assert sorted({(r["sig"], r["key"]) for r in met if r["kind"] == jaccard.LARGE}) == large
    assert sorted((r["other"], r["key"]) for r in met if r["kind"] == jaccard.PAIR) == pairs


def test_jaccard_of_rows_without_ids_and_ids_with_two_texts(spark):
    text = words(60, 1, 10_000)
    docs = spark.createDataFrame(
        [(None, " ".join(text)), (None, None), (1, " ".join(text)), (1, "one two"),
         (2, "one two"), (3, " ".join(text))], DOCS)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"])
             for r in jaccard.near_duplicates(docs).collect()}
    assert found[3] == (56, 1) and found[1] == (56, 1) and found[2] == (1, 1)
    assert set(found) == {None, 1, 2, 3}


def test_jaccard_broadcasts_no_table(spark, monkeypatch):
    plans = []
    for module in (jaccard, components):
        def kept(df, of=module.unsized):
            out = of(df)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return out
        monkeypatch.setattr(module, "unsized", kept)
    found = jaccard.near_duplicates(spark.createDataFrame(list(family_texts().items()), DOCS))
    found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 5
    assert not any("Broadcast" in p for p in plans)


def test_bands_meet_in_the_instance_of_the_smaller_set():
    for r in [*range(1, 300), 511, 512, 600, 682, 1000]:
        for s in range(r, r * 4 // 3 + 1):
            mine, other = ({n: (parts, differ) for n, parts, differ in jaccard.instances(x)}
                           for x in (r, s))
            number = 2 << (r.bit_length() - 1)
            assert mine[number][0] == other[number][0] > (r + s) // 7 // 2
            assert min(mine[number][1], other[number][1]) >= (r + s) // 7 // 2
    made = [sum(p for _, p, _ in jaccard.instances(s)) / s for s in range(512, 1024)]
    assert sum(made) / len(made) < 0.32  # 0.40 with an instance for each edge as well


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# Packing ------------------------------------------------------------------------------------

def test_packing_is_exact_and_tight(spark):
    texts = [None, "", "Hello, world's  end...", "<|endoftext|> x", "naïve café ΟΔΟΣ ﬁ é ½",
             "a\x1cb\tc d e", "they're '''s 12x34 ,,, a.b", "日本語 текст"] + [
        " ".join(words(n, n)) for n in (1, 50, 900, 3000, 20, 20)]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[3])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("clash"))
    out = packing.pack_documents(docs, capacity=256).collect()
    encode = Tokenizer.from_file(packing.TOKENIZER).encode
    wanted = Counter()
    for doc_id, text in rows:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for start in range(0, len(ids), 256):
            part = ids[start:start + 256]
            wanted[doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert wanted == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"],
                              r["doc_tokens"]) for r in out)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 256
    total = sum(r["length"] for r in out)
    assert len(by_sequence) <= -(-total // 256) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(5)
    lengths = sorted((rng.randrange(1, 100) for _ in range(400)), reverse=True)
    windows, offsets = packing.best_fit(lengths, 100)
    rooms = {}
    for length, window, offset in zip(lengths, windows, offsets):
        fitting = [room for room in rooms.values() if room >= length]
        assert rooms.get(window, 100) == (min(fitting) if fitting else 100) == 100 - offset
        rooms[window] = rooms.get(window, 100) - length


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, " ".join(words(30 * i, i))) for i in range(12)], DOCS)
    plan = packing.pack_documents(docs, capacity=128).cache()
    ids = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4")
           for r in packing.sequences(docs, plan, capacity=128).collect()}
    for r in plan.collect():
        part = ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]


# Decontamination ----------------------------------------------------------------------------

def test_passages_equal_brute_force(spark):
    item = words(25, 1)
    items = [(1, " ".join(item)), (2, "Short Item, here"), (3, None), (4, "..."),
             (5, " ".join(item[5:20])), (5, "short item HERE"), (None, "without any id")]
    texts = ["X " + " ".join(item[3:15]).upper() + " y", " ".join(item), "a short  item-here b",
             None, "", "?!", " ".join(item[:9]), "é" + " ".join(item[:10]), "without ANY id",
             " ".join(item * 3), "SHORT item here short item here"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_hit", F.lit("x"))
    table = spark.createDataFrame(items, "item_id long, text string")
    for shard_bytes in (1 << 20, 60):
        found = decontaminate.find_passages(docs, table, shard_bytes=shard_bytes).collect()
        for r in found:
            text = texts[r["doc_id"]]
            doc = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
            hit, ids = set(), set()
            for item_id, said in items:
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (said or "").translate(LOWER))
                n = min(10, len(w))
                windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
                for i in range(len(doc) - n + 1 if n else 0):
                    if tuple(doc[i:i + n]) in windows:
                        hit |= set(range(i, i + n))
                        ids |= {item_id} - {None}
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(doc), len(hit), sorted(ids))
            spans = [text[s["start"]:s["end"]] for s in r["spans"]]
            said = [x for s in spans for x in re.findall(
                r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate(LOWER))]
            assert said == [doc[i] for i in sorted(hit)]
    cut = decontaminate.without_passages(
        decontaminate.find_passages(docs.drop("n_hit"), table)).collect()
    assert {r["doc_id"]: r["text"] for r in cut}[0] == "X  y"
    assert decontaminate.find_passages(docs, table.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_passages(docs.limit(0), table).count() == 0


# Language models ----------------------------------------------------------------------------

def test_lm_scores_equal_a_plain_count(spark):
    rows = [(i, " ".join(words(80, i, 50)), i % 3 == 0) for i in range(20)]
    rows += [(20, None, True), (21, "  ", None), (22, "One, two.", None), (0, rows[0][1], True)]
    docs = spark.createDataFrame(rows, DOCS + ", good boolean").withColumn("n_tokens", F.lit("x"))
    models = lm.train(docs, F.col("good"))
    found = {r["doc_id"]: r for r in lm.score(docs, *models).collect()}

    def entropy(text, texts):
        one, pairs, classes = Counter(), Counter(), Counter()
        heads, size = Counter(), lm.CLASSES
        for t in texts:
            entries = [lm.entry(c) for c in (t or "").split()]
            before = [lm.START, *[e % size for e in entries]]
            one.update(entries)
            classes.update(e % size for e in entries)
            pairs.update(zip(before, [e % size for e in entries]))
            heads.update(before[:len(entries)])
        entries = [lm.entry(c) for c in text.split()]
        total, n = 0.0, sum(classes.values())
        for v, e in zip([lm.START, *[x % size for x in entries]], entries):
            share = (classes[e % size] + 1) / (n + size)
            after = (pairs[v, e % size] + lm.LEAN * share) / (heads[v] + lm.LEAN)
            within = (one[e] + lm.ADD) / (classes[e % size] + lm.ADD * (lm.WORDS // size))
            total -= np.log(after) + np.log(within)
        return total / len(entries)

    for doc_id in (0, 4, 22):
        text = next(t for i, t, _ in rows if i == doc_id)
        target = entropy(text, [t for _, t, good in rows if good])
        background = entropy(text, [t for _, t, _ in rows])
        assert found[doc_id]["target_entropy"] == pytest.approx(target, rel=1e-4)
        assert found[doc_id]["entropy_difference"] == pytest.approx(target - background, abs=1e-3)
    assert found[20]["entropy_difference"] is None and found[21]["n_tokens"] == 0
    assert lm.score(docs.limit(0), *models).count() == 0


def test_language_model_counts_each_word_for_itself(spark):
    """The words ``shared`` have the low 16 bits of their checksum in common with ``the``."""
    shared = [w for w in (f"x{i}" for i in range(400_000))
              if zlib.crc32(w.encode()) & 0xFFFF == zlib.crc32(b"the") & 0xFFFF][:3]
    rows = [(i, "the " * 50, True) for i in range(30)] + [(100 + i, "far off " * 20, False)
                                                        for i in range(30)]
    rows += [(200, " ".join(shared), False), (201, "the the", True)]
    docs = spark.createDataFrame(rows, DOCS + ", good boolean")
    found = {r["doc_id"]: r for r in lm.score_within(docs, F.col("good")).collect()}
    assert len(shared) == 3 and len(found) == len(rows)
    # A word of its own stands once in the background and never in the target.
    assert found[200]["target_entropy"] > found[201]["target_entropy"] + 3
    assert found[200]["entropy_difference"] > 0 > found[201]["entropy_difference"]
    apart = {r["doc_id"]: r for r in lm.score(docs, *lm.train(docs, F.col("good"))).collect()}
    for doc_id, row in found.items():
        assert row["target_entropy"] == pytest.approx(apart[doc_id]["target_entropy"])
        assert row["background_entropy"] == pytest.approx(apart[doc_id]["background_entropy"])


def test_language_model_gathers_with_the_input(spark):
    def keys(n):
        docs = spark.createDataFrame([(i, " ".join(words(500, i, 10 ** 9))) for i in range(n)],
                                     DOCS)
        counts, totals = lm.train(docs, F.lit(False))
        return sum(lm._length(r["pairs"]) for r in counts.select("pairs").collect()), totals

    (few, _), (many, totals) = keys(50), keys(400)
    assert few == 50 * 500 and many == 400 * 500
    assert totals.vocabulary == len({w for i in range(400) for w in words(500, i, 10 ** 9)})
