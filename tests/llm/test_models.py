"""Classifiers (held-out accuracy), vectors (brute force), components, the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import embedding, language, quality, toxicity
from corpuslens.llm.components import components
from corpuslens.llm.text import held_out, table

SF = "/root/testdata/sf0.01"
NO_DOCS = "doc_id long, text string, n_chars long, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


ODD = [(1, None, None, None, None), (2, "", -5, "xx", ""), (3, "\x00퟿ é", 3, "en", "s"),
       (4, "word " * 50_000, 1, "en", "s"), (4, "word " * 50_000, 1, "en", "s")]


def test_quality_on_held_out_documents(spark, docs, labels):
    model = quality.train(docs, labels)
    scored = quality.score(docs.drop("lang", "source"), model).join(labels, "doc_id").select(
        "quality", "score", held_out(F.col("doc_id")).alias("held")).toPandas()
    held = scored[scored.held]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean(good.to_numpy()[:, None] > bad.to_numpy()) > 0.97
    assert (good >= quality.REJECT_BELOW).mean() > 0.97
    odd = quality.score(spark.createDataFrame(ODD, NO_DOCS).withColumn("score", F.lit("x")), model)
    rows = odd.collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[3]["score"] == rows[4]["score"]
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_labels(docs, labels):
    model = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs.limit(5), model).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    model = quality.Machine(0.3, rng.normal(size=quality.SIZE),
                            rng.normal(size=(quality.SIZE, quality.RANK)))
    feature, value = np.array([3, 70, 900, 5]), rng.normal(size=4)
    pairs = sum(model.factors[feature[i]] @ model.factors[feature[j]] * value[i] * value[j]
                for i in range(4) for j in range(i))
    margin, _ = model.margins(np.zeros(4, int), feature, value, 1)
    assert margin[0] == pytest.approx(0.3 + model.linear[feature] @ value + pairs)


def test_toxicity_grades(spark):
    rng = random.Random(2)
    bad = ["awful", "nasty", "vile"]
    rows, marks = [], []
    for i in range(600):
        text = [f"w{rng.randrange(300)}" for _ in range(60)]
        if i % 6 == 0:
            for _ in range(rng.randrange(1, 9)):
                text.insert(rng.randrange(len(text)), rng.choice(bad).upper() + "!")
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 6 == 0)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(texts, known)
    assert (np.diff(model.thresholds) > 0).all()
    found = toxicity.grade_documents(texts.withColumn("severity", F.lit("x")), model).collect()
    assert np.mean([r["toxic"] == (r["doc_id"] % 6 == 0) for r in found]) > 0.98
    odd = toxicity.grade_documents(spark.createDataFrame(
        [(1, None), (2, ""), (3, "vile " * 9), (4, "w1 vile")], "doc_id long, text string"), model)
    severity = {r["doc_id"]: r["expected_severity"] for r in odd.collect()}
    assert severity[1] == severity[2] < severity[4] < severity[3]
    assert toxicity.grade_documents(texts.limit(0), model).count() == 0
    none = toxicity.train(texts, known.filter("toxic = 0"))
    assert not any(r["toxic"] for r in toxicity.grade_documents(texts, none).collect())


def test_toxicity_on_held_out_documents(spark):
    sf = SF.replace("0.01", "0.1")
    texts, known = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(texts, known)
    found = (toxicity.grade_documents(texts.select("doc_id", "text"), model)
             .withColumnRenamed("toxic", "said").join(known, "doc_id")
             .filter(held_out(F.col("doc_id"))).select("toxic", "said").toPandas())
    assert found[found.toxic == 1].said.mean() > 0.85
    assert found[found.toxic == 0].said.mean() < 0.02


def test_language_on_held_out_documents(spark, docs):
    model = language.train(docs.filter(~held_out(F.col("doc_id"))))
    found = language.identify(docs.filter(held_out(F.col("doc_id"))), model, "text",
                              host=F.col("source"), suffix=F.lit(None).cast("string"),
                              declared=F.lit(None).cast("string"))
    assert found.filter("lang_id = lang AND accepted").count() >= 0.98 * found.count()


def test_language_evidence_is_fused(spark, docs):
    model = language.train(docs)
    rows = [(i, "https://a.example.de/x", "<html lang='de'><p>Der und die nicht mit.</p>")
            for i in range(30)]
    rows += [(90, "https://a.example.de/y", None), (91, None, "<p>12 34</p>"), (92, "", ""),
             (93, "https://ru.example.org", "<p>" + "привет мир это текст " * 9),
             (94, "//u@b.example.fr:80/", "<HTML class=x lang=fr-FR><nav>the and of</nav>"),
             (90, "https://a.example.de/y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumn("accepted", F.lit("x")).withColumn("host_n", F.lit(0))
    host = language.host_of(F.col("url"))
    found = language.identify(pages, model, "html", host, language.suffix_of(host),
                              language.declared_in(F.col("html")), markup=True).collect()
    by_id = {r["page_id"]: r for r in found}
    assert len(found) == len(rows)
    assert by_id[0]["lang_id"] == "de" and by_id[90]["lang_id"] == "de"
    assert by_id[90]["text_lang"] is None and by_id[94]["n_letter_words"] == 0
    assert by_id[93]["lang_id"] == "und" and not by_id[93]["accepted"]
    one = pages.select(host.alias("h"), language.suffix_of(host).alias("s"),
                       language.declared_in(F.col("html")).alias("d")).filter("s = 'fr'").first()
    assert tuple(one) == ("b.example.fr", "fr", "fr")
    assert language.identify(pages.limit(0), model, "html", host, F.lit(None).cast("string"),
                             F.lit(None).cast("string")).count() == 0


def brute_vectors(rows, similarity):
    usable = {i: (label, np.array(v, float)) for i, v, label in rows
              if label is not None and v and all(x is not None and np.isfinite(x) for x in v)
              and any(v)}
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(usable)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            (la, x), (lb, y) = usable[a], usable[b]
            if la == lb and len(x) == len(y) and (
                    x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= similarity):
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i), root(i) == i) for i in links}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 25)):
                v = (centre + rng.normal(scale=0.28, size=16)) * rng.uniform(0.1, 9)
                rows.append((n, v.astype(np.float32).tolist(), label))
                n += 1
    rows += [(n, [1.0] * 16, 1), (n + 1, [2.0] * 16, 1), (n + 2, None, 1), (n + 3, [], 1),
             (n + 4, [0.0] * 16, 1), (n + 5, [float("nan")] * 16, 1), (n + 6, [None] * 16, 1),
             (n + 7, [float("inf")] * 16, 1), (n + 8, [1.0, 2.0], 1), (n + 9, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.union(df.limit(1)).withColumn("v", F.lit("x"))
    found = embedding.near_vectors(df, block=16).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == (
        brute_vectors(rows, 0.93))
    assert len(found) == len(rows)
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(1, 7)] + [(9, 9)]
    links += [(i, i) for i in (3, 3)] + [(200, 201), (201, 200)]
    random.Random(1).shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == (
        {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 8)} | {200: 200, 201: 200})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_guessed_sizes_stay_short_over_many_rounds(spark):
    rng = random.Random(8)
    order = rng.sample(range(300), 300)
    links = list(zip(order, order[1:]))  # a long chain takes several rounds and doublings
    found = components(spark.createDataFrame(links, "a long, b long"))
    guess = found._jdf.queryExecution().optimizedPlan().stats().simpleString()
    exponent = re.search(r"E\+(\d+)", guess)
    assert exponent is None or int(exponent[1]) < 200, guess
    assert {r["component"] for r in found.collect()} == {0}


def test_rows_that_go_stay_with_the_executors(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id % 30 doc_id", "cast(id as string) text")
    monkeypatch.setattr(type(docs), "toArrow", None)
    for most in (200_000, 3):
        monkeypatch.setattr(corpus_pipeline, "SMALL_ROWS", most)
        left = corpus_pipeline._without(docs, spark.range(10, 20).toDF("doc_id"),
                                        {"doc_id": F.col("doc_id")})
        assert sorted(r["doc_id"] for r in left.collect()) == sorted(
            i % 30 for i in range(40) if not 10 <= i % 30 < 20)


def test_pipeline_stages(spark, docs):
    odd = spark.createDataFrame(ODD, NO_DOCS).select(docs.columns)
    for start in (docs.limit(150).unionByName(odd), docs.limit(0)):
        current = start.withColumn("score", F.lit("mine")).withColumn("n_hit", F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            before = current
            current = stage(spark, before, SF).cache()
            if name != "packing":
                assert current.columns == before.columns
                assert current.exceptAll(before).count() == 0
    assert current.count() == 0


def test_pipeline_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "other"), (4, "other"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 4]


def test_toxicity_keeps_natural_shares_where_the_sample_is_even(spark):
    """``edgy`` stands in a fifth as many toxic documents as clean ones: it must not tell."""
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(4000):
        toxic = i % 20 == 0
        text = [f"w{rng.randrange(300)}" for _ in range(40)]
        if toxic:
            text[rng.randrange(40)] = "vile"
        if rng.random() < (0.9 if toxic else 0.22):
            text[rng.randrange(40)] = "edgy"
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    known = spark.createDataFrame(marks, "doc_id long, toxic int")
    edgy, vile = (toxicity.word_bin(w) for w in ("edgy", "vile"))
    for sample in (8000, 320):  # all labels, and an even sample
        model = toxicity.train(texts, known, sample)
        assert model.slot[vile] >= 0 > model.slot[edgy]
        said = {r["doc_id"]: r["toxic"] for r in toxicity.grade_documents(texts, model).collect()}
        assert np.mean([said[i] for i, _ in rows if i % 20]) < 0.01


def test_declared_language_of_long_tags(spark):
    pages = [("<html data-x='" + "y" * 5000 + "' lang='FR'><p lang=de>", "fr"),
             ("<HTML LANG=en-GB>", "en"), ("<html><p lang=de>", None), ("no tag", None), (None, None),
             ("<html " + "a " * 500_000, None)]
    df = spark.createDataFrame(pages, "html string, wanted string")
    for row in df.select(language.declared_in(F.col("html")).alias("found"), "wanted").collect():
        assert row["found"] == row["wanted"]
