"""Clauses, ranking, fuzzy matching and modes on small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens import SearchOptions, build_index, index_search, ranked_documents, search
from corpuslens.functions.scoring import length_norm
from corpuslens.operators import bounded, fuzzy
from corpuslens.operators.clauses import query_clauses, query_errors, query_table, read_queries
from corpuslens.operators.fuzzy import expansions, near_terms
from corpuslens.plans import coordinator, early, refresh, retrieve
from corpuslens.plans.index import refuse_shared_ids, save_index
from corpuslens.registry.inputs import ALL_QUERIES
from corpuslens.sources.tables import with_metadata
from tests.test_functions import _osa


def _plain(spark, text, **flags):
    options = {"case_sensitive": False, "fuzzy": False, "phrase": False, "k": 20} | flags
    return query_table(spark, [(1, text, *options.values())])


def _docs(spark, *texts):
    return spark.createDataFrame(
        [(i, f"/d/{i}.txt", text, i) for i, text in enumerate(texts)],
        "doc_id long, path string, text string, mtime_us long")


@pytest.mark.parametrize("text, clauses", [
    ("a b", [("a", "must"), ("b", "must")]),
    ("a OR b", [("a", "should"), ("b", "should")]),
    ("a b OR c", [("a", "must"), ("b", "should"), ("c", "should")]),
    ("a OR b AND c", [("a", "should"), ("b", "must"), ("c", "must")]),
    ("a AND NOT b", [("a", "must"), ("b", "not")]),
    ("a NOT b OR c", [("a", "must"), ("b", "not"), ("c", "should")]),
    ("NOT a", [("a", "not")]),
    ("a or b", [("a", "must"), ("or", "must"), ("b", "must")]),
    ("a !!! OR b", [("a", "should"), ("b", "should")]),
    ("!!!", []),
    ("+a -b (c)", [("+a", "must"), ("-b", "must"), ("(c)", "must")]),
])
def test_clauses(spark, text, clauses):
    row = read_queries(_plain(spark, text)).first()
    assert row["error"] is None
    assert [(c["word"], c["occur"]) for c in row["clauses"]] == clauses


@pytest.mark.parametrize("text", ["", "  ", "AND a", "OR", "a AND", "a NOT", "a AND OR b",
                                  "NOT NOT a", "NOT AND a"])
def test_malformed_queries(spark, text):
    assert query_errors(_plain(spark, text)).count() == 1


@pytest.mark.parametrize("text", ["", "a OR b", "NOT a"])
def test_malformed_fuzzy_queries(spark, text):
    assert query_errors(_plain(spark, text, fuzzy=True)).count() == 1


def test_empty_phrase_is_no_error_and_has_no_rows(spark):
    index = build_index(_docs(spark, "a b", "c"))
    query = _plain(spark, "", phrase=True)
    assert query_errors(query).count() == 0
    assert ranked_documents(index, query).count() == 0


def test_a_batch_runs_beside_bad_queries(spark):
    index = build_index(_docs(spark, "a b", "c"))
    queries = query_table(spark, [(1, "a", False, False, False, 5), (2, "a OR", False, False,
                                                                    False, 5)])
    assert [r["query_id"] for r in ranked_documents(index, queries).collect()] == [1]
    assert [r["query_id"] for r in query_errors(queries).collect()] == [2]


def test_field_and_tokens_of_a_clause(spark):
    row = query_clauses(_plain(spark, "Foo-Bar", case_sensitive=True)).first()
    assert row["field"] == "content_case"
    assert [(t["term"], t["offset"]) for t in row["tokens"]] == [("Foo", 0), ("Bar", 1)]
    row = query_clauses(_plain(spark, "Foo-Bar")).first()
    assert [t["term"] for t in row["tokens"]] == ["foo", "bar"]


def _found(index, query):
    return [r["doc_id"] for r in ranked_documents(index, query).orderBy("rank").collect()]


def test_meanings(spark):
    index = build_index(_docs(spark, "foo bar", "bar foo", "foo", "Foo baz", "", "the the the"))
    assert sorted(_found(index, _plain(spark, "foo bar"))) == [0, 1]
    assert _found(index, _plain(spark, "foo bar", phrase=True)) == [0]
    assert sorted(_found(index, _plain(spark, "foo-bar"))) == [0, 1]
    assert sorted(_found(index, _plain(spark, "foo NOT bar"))) == [2, 3]
    assert _found(index, _plain(spark, "NOT bar")) == []
    assert _found(index, _plain(spark, "Foo", case_sensitive=True)) == [3]
    assert sorted(_found(index, _plain(spark, "baz OR bar"))) == [0, 1, 3]
    assert _found(index, _plain(spark, "the the", phrase=True)) == [5]
    assert _found(index, _plain(spark, "the the the the", phrase=True)) == []
    assert sorted(_found(index, _plain(spark, "boo", fuzzy=True))) == [0, 1, 2, 3]
    assert sorted(_found(index, _plain(spark, "OOF", fuzzy=True, case_sensitive=True))) == [
        0, 1, 2, 3]
    assert _found(index, _plain(spark, "foo-bar", fuzzy=True)) == []


def test_ties_go_by_document(spark):
    index = build_index(_docs(spark, *["same words"] * 5))
    assert _found(index, _plain(spark, "same", k=3)) == [0, 1, 2]


@pytest.mark.parametrize("word, term, found", [
    ("form", "from", (1, 0.75)), ("ca", "abc", None), ("ab", "cd", None),
    ("chtung", "chtüng", (1, 1 - 1 / 6)), ("foo", "Foo", (1, 1 - 1 / 3)), ("foo", "foo", (0, 1.0))])
def test_expansion(spark, word, term, found):
    vocab = spark.createDataFrame([("f", term, 1, 1)],
                                  "field string, term string, df long, cf long")
    words = spark.createDataFrame([("f", word)], "field string, word string")
    rows = expansions(vocab, words).collect()
    assert [round(r["boost"], 9) for r in rows] == ([round(found[1], 9)] if found else [])


@pytest.mark.parametrize("few", [0, 1000])
def test_near_terms_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(fuzzy, "FEW_WORDS", few)
    random.seed(11)
    base = ["".join(random.choices("abcdeü", k=k)) for k in (1, 2, 3, 4, 6, 9, 14) * 12]
    base += ["".join(random.choices("abcdefgh", k=k)) for k in range(17, 27) for _ in range(4)]
    base += ["x" * k for k in (3, 5, 20, 22, 60)]

    def spoil(word):
        for _ in range(random.randint(0, 3)):
            at = random.randint(0, len(word))
            kind = random.randint(0, 3)
            if kind == 0:
                word = word[:at] + random.choice("abü") + word[at:]
            elif kind == 1:
                word = word[:at] + word[at + 1:]
            elif kind == 2:
                word = word[:at] + random.choice("abü") + word[at + 1:]
            elif at + 1 < len(word):
                word = word[:at] + word[at + 1] + word[at] + word[at + 2:]
        return word

    terms = sorted({spoil(w) for w in base for _ in range(3)} - {""})
    words = sorted({spoil(w) for w in base} - {""})
    vocab = spark.createDataFrame([("f", t, 1, 2) for t in terms],
                                  "field string, term string, df long, cf long")
    asked = spark.createDataFrame([("f", w) for w in words], "field string, word string")
    rows = near_terms(vocab, asked).collect()
    got = sorted((r["word"], r["term"], r["distance"], r["df"]) for r in rows)
    assert got == sorted((w, t, _osa(w, t), 1) for w in words for t in terms if _osa(w, t) <= 2)


def test_fuzzy_cap_keeps_the_best(spark):
    terms = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"] + ["word"]
    vocab = spark.createDataFrame([("f", t, 1, 1) for t in terms],
                                  "field string, term string, df long, cf long")
    words = spark.createDataFrame([("f", "word")], "field string, word string")
    kept = [r["term"] for r in expansions(vocab, words).collect()]
    assert len(kept) == 50 and "word" in kept
    assert sorted(kept) == sorted(["word", *sorted(terms[:-1])[:49]])


def test_large_batches_give_the_same_rows(spark, monkeypatch, tmp_path):
    """The way without broadcasts, and a saved index, against the small in-memory way."""
    random.seed(2)
    texts = [" ".join(random.choices("the of with wiht teh Tha der die foo bar".split(), k=40))
             for _ in range(60)]
    docs = _docs(spark, *texts)
    queries = query_table(spark, [q.row(i) for i, q in ALL_QUERIES.items()])
    expected = sorted(tuple(r) for r in ranked_documents(build_index(docs), queries).collect())
    saved = save_index(spark, docs, str(tmp_path / "index"), buckets=4)
    assert sorted(tuple(r) for r in ranked_documents(saved, queries).collect()) == expected
    hits = sorted(tuple(r)[:2] for r in index_search(saved, queries).collect())
    settle = bounded.settle
    for module in (retrieve, fuzzy):
        monkeypatch.setattr(module, "settle", lambda df: settle(df, limit=2))
    assert sorted(tuple(r) for r in ranked_documents(saved, queries).collect()) == expected
    assert sorted(tuple(r)[:2] for r in index_search(saved, queries).collect()) == hits
    assert len(expected) > 100


def test_saved_search_shuffles_no_postings(spark, tmp_path):
    docs = _docs(spark, *[f"the with of {i}" for i in range(50)])
    saved = save_index(spark, docs, str(tmp_path / "index"), buckets=4)
    terms, rows = retrieve.weighted_terms(saved, _plain(spark, "the with"))
    plan = retrieve.scored(saved, terms, rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "In(term, [the,with])" in plan


def test_leading_terms_change_no_result(spark, monkeypatch):
    random.seed(8)
    texts = [" ".join(random.choices("the of with wiht teh The der die foo bar getz".split(),
                                     [30, 20, 5, 1, 1, 1, 3, 2, 1, 1, 1], k=12)) for _ in range(80)]
    index = build_index(_docs(spark, *texts))
    queries = query_table(spark, [q.row(i) for i, q in ALL_QUERIES.items()])
    expected = {tuple(r) for r in ranked_documents(index, queries).collect()}
    monkeypatch.setattr(retrieve, "leads_pay", lambda rows, n_docs: True)
    assert {tuple(r) for r in ranked_documents(index, queries).collect()} == expected
    assert {r[0] for r in expected} >= {1, 2, 3, 4, 5, 6, 7}


def test_shared_frequent_terms_are_led_by_rare_ones():
    def row(term, df, lead):
        return {"field": "content", "term": term, "df": df, "lead": lead}
    shared = [row("the", 6_000_000, False), row("rare", 2, True)]
    assert not retrieve.leads_pay(shared, 10_000_000)
    assert retrieve.leads_pay(shared * 50, 10_000_000)
    assert retrieve.leads_pay(None, 10_000_000)


def test_invariants_of_refresh(spark):
    docs = with_metadata(_docs(spark, "the first", "the second", "of the third"))
    index = build_index(docs)
    again = refresh.refresh_index(index, docs)
    assert tuple(again.stats.first()) == (0, 3, 0)
    assert (sorted(map(str, again.index.postings.collect()))
            == sorted(map(str, index.postings.collect())))
    fewer = docs.filter("doc_id > 0").withColumn("mtime_us", F.col("mtime_us") + 1)
    pruned = refresh.refresh_index(index, fewer, prune=True).index
    rebuilt = build_index(fewer)
    for table in ("docs", "postings"):
        assert (sorted(map(str, getattr(pruned, table).collect()))
                == sorted(map(str, getattr(rebuilt, table).collect())))
    assert (sorted(map(str, pruned.terms().collect()))
            == sorted(map(str, rebuilt.terms().collect())))
    stale = refresh.refresh_index(index, fewer).index
    assert stale.docs.count() == 3


def test_shared_ids_are_refused(spark):
    docs = _docs(spark, "a", "b").withColumn("doc_id", F.lit(1))
    with pytest.raises(ValueError):
        refuse_shared_ids(docs)


MODES = [
    (dict(search_content=False, content_search_mode="index"), True, "scan", []),
    (dict(content_search_mode="scan"), True, "scan", []),
    (dict(content_search_mode="index", use_regex=True), True, "none",
     [("warning", coordinator.NO_REGEX)]),
    (dict(use_regex=True), True, "scan", [("status", coordinator.REGEX_SCAN)]),
    (dict(content_search_mode="index", content_index_path="/x"), False, "none",
     [("warning", "No content index found at '/x'.")]),
    (dict(), False, "scan", [("status", coordinator.NO_INDEX_SCAN)]),
    (dict(), True, "index", []),
    (dict(content_search_mode="index"), True, "index", []),
]


@pytest.mark.parametrize("options, present, action, messages", MODES)
def test_modes(options, present, action, messages):
    chosen = SearchOptions(**({"search_term": "x", "search_content": True} | options))
    assert coordinator.resolve(chosen, present) == (action, messages)


def test_both_modes_keep_their_meaning_of_two_words(spark):
    docs = with_metadata(_docs(spark, "foo bar", "bar x foo", "nothing"))
    index = build_index(docs)
    options = dict(search_term="foo bar", search_content=True)
    scanned = search(spark, SearchOptions(content_search_mode="scan", **options), files=docs,
                     index=index)
    assert [r["path"] for r in scanned.hits.collect()] == ["/d/0.txt"]
    assert tuple(scanned.stats.first()) == (3, 1, 0)
    indexed = search(spark, SearchOptions(**options), files=docs, index=index)
    rows = indexed.hits.collect()
    assert [(r["path"], r["snippet"], r["source"]) for r in rows] == [
        ("/d/0.txt", "**foo** **bar**", "index"), ("/d/1.txt", "**bar** x **foo**", "index")]
    assert tuple(indexed.stats.first()) == (0, 2, 0)
    nothing = search(spark, SearchOptions(content_search_mode="index", **options), files=docs)
    assert nothing.hits.count() == 0 and tuple(nothing.stats.first()) == (0, 0, 0)


def test_bad_requests_raise(spark):
    docs = with_metadata(_docs(spark, "a"))
    with pytest.raises(ValueError):
        search(spark, SearchOptions(search_term="a AND", search_content=True),
               index=build_index(docs))
    with pytest.raises(ValueError):
        search(spark, SearchOptions(search_term="(", use_regex=True), files=docs)


def test_counters_in_one_pass(spark):
    from pyspark.sql import Observation

    from corpuslens import scan_search
    docs = with_metadata(_docs(spark, "foo", "bar"))
    seen = Observation("scan")
    hits, _ = scan_search(docs, SearchOptions(search_term="foo", search_content=True), seen)
    assert hits.count() == 1
    assert seen.get == {"files_scanned": 2, "matches_found": 1, "files_skipped": 0}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stepped(spark, root, rounds):
    """A saved index and some refreshes, each of which changes a few documents and adds one."""
    texts = {i: f"the base text {i} with" for i in range(30)}

    def files():
        return with_metadata(spark.createDataFrame(
            [(i, f"/d/{i}.txt", text, len(text) * 1000 + i) for i, text in texts.items()],
            "doc_id long, path string, text string, mtime_us long"))

    save_index(spark, files(), root, buckets=3)
    for r in range(rounds):
        for i in (r, r + 1, 7):
            texts[i] = f"round {r} of the text {i} " + "more " * r
        texts[100 + r] = f"new in round {r}"
        index, _ = refresh.refresh_saved(spark, root, files())
    return index, files()


def test_refreshed_layers_equal_a_rebuild(spark, tmp_path):
    index, files = _stepped(spark, str(tmp_path / "steps"), 4)
    rebuilt = build_index(files)
    assert len(index.layers) == 5 and index.n_docs == rebuilt.docs.count() == 34
    for table in ("docs", "postings"):
        assert (sorted(map(str, getattr(index, table).collect()))
                == sorted(map(str, getattr(rebuilt, table).collect())))
    assert (sorted(map(str, index.terms().collect()))
            == sorted(map(str, rebuilt.terms().collect())))
    # One join with the removed ids for each layer that has later ones.
    postings = refresh.open_index(spark, str(tmp_path / "steps")).postings
    assert _plan(postings).count("LeftAnti") == 4


def test_removed_counts_read_no_postings(spark, tmp_path):
    index, _ = _stepped(spark, str(tmp_path / "steps"), 2)
    gone, rows = bounded.settle(spark.createDataFrame([(3,), (7,)], "doc_id long"))
    for ids in (rows, None):
        lost = refresh.removed_counts(index, gone, ids)
        read = {path.rsplit("/", 2)[-2] for path in lost.inputFiles()}
        assert read == {"docs", "removed"}
        assert ("In(doc_id, [3,7])" in _plan(lost)) == (ids is not None)
        expected = index.postings.filter("doc_id in (3, 7)").groupBy("field", "term").agg(
            (-F.count("*")).alias("df"), (-F.sum("tf")).alias("cf"), F.lit(None).alias("top"))
        assert sorted(map(tuple, lost.collect())) == sorted(map(tuple, expected.collect()))


def test_plain_builds_take_one_version_per_path(spark, tmp_path):
    rows = [("/a.txt", "old words", 1), ("/a.txt", "new words", 2), ("/b.txt", "same", 1),
            ("/b.txt", "same", 1), ("/c.txt", "tied x", 5), ("/c.txt", "tied y", 5)]
    docs = spark.createDataFrame(rows, "path string, text string, mtime_us long")
    for index in (build_index(docs), save_index(spark, docs, str(tmp_path / "plain"))):
        found = sorted((r["path"], r["text"]) for r in index.docs.collect())
        assert len(found) == 3 and found[:2] == [("/a.txt", "new words"), ("/b.txt", "same")]
        assert sorted(r["term"] for r in index.terms().filter("field = 'content'").collect()) == (
            sorted(["new", "same", "tied", "words", found[2][1][-1]]))
    with_ids = _docs(spark, "x", "y").withColumn("path", F.lit("/one.txt"))
    assert [r["text"] for r in build_index(with_ids).docs.collect()] == ["y"]


def test_buckets_follow_the_bytes(spark, tmp_path):
    from corpuslens.plans import index as plans
    parallel = spark.sparkContext.defaultParallelism
    mb = 1 << 20
    assert [plans.bucket_count(spark, n) for n in (0, 10, mb, 2 * mb, 100 * mb)] == [
        1, 1, 1, min(2, parallel), parallel]
    assert plans.bucket_count(spark, 1 << 40) == 4096
    saved = save_index(spark, _docs(spark, "one", "two"), str(tmp_path / "small"))
    assert saved.postings.rdd.getNumPartitions() == 1


def _or_batch(spark, k):
    texts = ["the OR rare", "rare OR the OR of", "the OR of", "with OR the NOT rare",
             "getz-rare OR the OR of", "rare OR nowhere", "of OR of OR rare", "the OR der"]
    return query_table(spark, [(i, t, False, False, False, k) for i, t in enumerate(texts)])


@pytest.mark.parametrize("k", [1, 3, 10, 500])
def test_early_top_k_equals_the_plain_way(spark, monkeypatch, tmp_path, k):
    random.seed(k)
    texts = [" ".join(random.choices(
        "the of with der getz rare".split(), [60, 40, 10, 8, 3, 1], k=random.randint(1, 25)))
        for _ in range(150)]
    saved = save_index(spark, _docs(spark, *texts), str(tmp_path / "index"), buckets=3)
    queries = _or_batch(spark, k)
    expected = sorted(tuple(r) for r in ranked_documents(saved, queries).collect())
    assert {r[0] for r in expected} >= set(range(8))
    monkeypatch.setattr(retrieve, "WORTH_NAMING", 0)
    assert sorted(tuple(r) for r in ranked_documents(saved, queries).collect()) == expected
    monkeypatch.setattr(retrieve, "few_led", lambda rows: False)
    monkeypatch.setattr(retrieve, "leads_pay", lambda rows, n_docs: True)
    assert sorted(tuple(r) for r in ranked_documents(saved, queries).collect()) == expected


def _term_rows(index, queries):
    return retrieve.weighted_terms(index, queries)[1]


def test_frequent_words_lead_only_if_they_can_reach_the_hits(spark):
    index = build_index(_docs(spark, *["the of"] * 90, *["rare the x y"] * 5, *["the"] * 5))
    rows = _term_rows(index, _plain(spark, "the OR rare", k=2))
    led = early.probe(rows)
    assert {r["term"] for r in led if r["lead"]} == {"rare"}
    best = ranked_documents(index, _plain(spark, "the OR rare", k=2)).collect()
    assert early.undecided(led, [r.asDict() for r in best]) == []
    # Fewer hits than asked for, or hits below the bound, decide nothing.
    for found in ([], [{"query_id": 1, "score": 0.0}] * 2):
        again = early.undecided(led, found)
        assert {r["term"] for r in again if r["lead"]} == {"rare", "the"}
    assert early.probe(_term_rows(index, _plain(spark, "the rare"))) is None
    assert early.probe(_term_rows(index, _plain(spark, "rare", phrase=True))) is None
    assert early.probe(None) is None


def test_bounds_hold_after_refreshes(spark, tmp_path):
    index, _ = _stepped(spark, str(tmp_path / "steps"), 3)
    share = F.sqrt(F.col("tf").cast("double")) * length_norm(F.col("doc_len"))
    most = index.postings.groupBy("field", "term").agg(F.max(share).alias("most"))
    joined = most.join(index.bounds(index.vocab), ["field", "term"]).collect()
    assert len(joined) == index.terms().count() and all(r["top"] >= r["most"] for r in joined)
    unknown = index.bounds(index.vocab.withColumn("top", F.lit(None).cast("double")))
    assert {r["top"] for r in unknown.collect()} == {1.0}


def test_named_documents_reach_the_reader(spark, monkeypatch, tmp_path):
    """Postings of a frequent word are read only for the documents of the rare one."""
    monkeypatch.setattr(retrieve, "WORTH_NAMING", 0)
    docs = _docs(spark, *["the rare" if i % 40 == 7 else "the of" for i in range(200)])
    saved = save_index(spark, docs, str(tmp_path / "index"), buckets=4)
    for text in ("the rare", "the OR rare"):
        terms, rows = retrieve.weighted_terms(saved, _plain(spark, text, k=2))
        found = retrieve.term_matches(saved, saved.postings, terms, early.probe(rows) or rows)
        if text == "the rare":
            spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
            plan = _plan(found)
            spark.conf.unset("spark.sql.maxMetadataStringLength")
            assert "In(doc_id, [127,167,47,7,87])" in plan
            assert "Exchange hashpartitioning" not in plan
            assert sorted({r["doc_id"] for r in found.collect()}) == [7, 47, 87, 127, 167]
        else:
            assert [r["doc_id"] for r in ranked_documents(
                saved, _plain(spark, text, k=2)).orderBy("rank").collect()] == [7, 47]


def test_buckets_are_small_enough_to_be_sorted_in_memory(spark):
    from corpuslens.plans.index import bucket_count

    tasks = spark.sparkContext.defaultParallelism
    assert bucket_count(spark, 100) == 1
    for size in (1 << 30, 12 << 30):
        buckets = bucket_count(spark, size)
        assert size / buckets <= 16 << 20 and buckets % tasks == 0


def test_each_bucket_is_sorted_by_a_task_of_its_own(spark, tmp_path):
    from corpuslens.plans.index import texts_by_bucket

    docs = _docs(spark, *[f"word {i}" for i in range(40)])
    index = save_index(spark, docs, str(tmp_path / "index"), buckets=16)
    parts = texts_by_bucket(spark, f"{tmp_path}/index/v=1/docs", 16).rdd.glom().collect()
    ids = [[r["doc_id"] for r in part] for part in parts]
    assert len(ids) == 16 and all(part == sorted(part) for part in ids)
    assert sum(len(part) for part in ids) == index.n_docs == 40
    assert sum(bool(part) for part in ids) > 8
