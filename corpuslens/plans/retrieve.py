"""Ranked retrieval: one plan for one query and for a table of queries.

1. The queries are cut into clauses and tokens, and looked up in the vocabulary (small tables).
2. Their terms meet the postings in one join. Everything after it works per (query, document):
   clauses, phrases, score. On a saved index these groups lie within a bucket, so nothing is
   shuffled; otherwise matched rows are shuffled once.
3. Only the best k hits of a query are joined with paths and texts.

Where that saves much, the documents of a query's rarest words are found first, and only their
rows of the frequent words are read. A query of words that may all be missing is then checked: if
the words left out cannot lift a document to the k-th score found, the hits are final; else it is
run again, led by all words that the bound does not rule out (``plans/early.py``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.scoring import SCORE_PLACES, idf, length_norm, tf
from corpuslens.functions.snippet import snippet
from corpuslens.functions.text import blank
from corpuslens.operators.bounded import SPELLED_VALUES, among, hinted, settle
from corpuslens.operators.clauses import MUST, NOT, SHOULD, query_clauses, query_errors
from corpuslens.operators.fuzzy import expansions
from corpuslens.plans import early
from corpuslens.plans.index import Index
from corpuslens.schema import SOURCE_INDEX

# With fewer rows than this a second pass over the postings costs more than it saves.
WORTH_LEADING = 20_000_000
# With fewer rows than this to spare, looking the documents up first costs more than it saves.
WORTH_NAMING = 2_000_000
CLAUSE = ["query_id", "k", "kind", "field", "n_must", "n_counted", "slot", "occur"]


def _exact_terms(index: Index, clauses: DataFrame, rows: list[dict] | None) -> DataFrame:
    """Tokens of plain and phrase clauses with their document frequency (0 if unknown)."""
    tokens = (clauses.filter("kind <> 'fuzzy'")
              .select(*CLAUSE, F.size("tokens").alias("need"), F.inline("tokens")))
    wanted = tokens.select("field", "term")
    asked = None if rows is None else [t for row in rows for t in row["tokens"]]
    entries = among(among(index.vocab, "field", rows), "term", asked)
    known = index.bounds(entries.join(hinted(wanted, asked), ["field", "term"], "left_semi"))
    return (tokens.join(hinted(known, asked), ["field", "term"], "left")
            .withColumn("df", F.coalesce("df", F.lit(0)))
            .withColumn("top", F.coalesce("top", F.lit(0.0)))
            .withColumn("boost", F.lit(1.0)))


def _fuzzy_terms(index: Index, clauses: DataFrame) -> DataFrame:
    """The expansions of fuzzy clauses; one of them is enough."""
    words = clauses.filter("kind = 'fuzzy'").select(*CLAUSE, "word")
    found = expansions(index.vocab, words.select("field", "word").distinct())
    return (words.join(found, ["field", "word"])
            .withColumn("need", F.lit(1)).withColumn("offset", F.lit(0))
            .withColumn("top", F.lit(1.0)))


def weighted_terms(index: Index, queries: DataFrame) -> tuple[DataFrame, list[dict] | None]:
    """One row per query term with its weight; local and with its rows if the batch is small.

    A plain or fuzzy term weighs ``idf^2 * boost * queryNorm``. All terms of a phrase share the
    weight of the sum of their idf.
    """
    clauses, rows = settle(query_clauses(queries))
    kinds = {r["kind"] for r in rows} if rows is not None else {"plain", "phrase", "fuzzy"}
    parts = []
    if kinds - {"fuzzy"} or not kinds:
        parts.append(_exact_terms(index, clauses, rows))
    if "fuzzy" in kinds:
        parts.append(_fuzzy_terms(index, clauses))
    columns = [*CLAUSE, "need", "term", "offset", "df", "top", "boost"]
    terms = parts[0].select(columns)
    for part in parts[1:]:
        terms = terms.unionByName(part.select(columns))
    query = W.partitionBy("query_id")
    terms = terms.withColumn("idf", idf(F.lit(float(index.n_docs)), F.col("df")))
    terms = terms.withColumn("idf_sum", F.sum("idf").over(query))
    squares = (F.when(F.col("occur") == NOT, 0.0)
               .when(F.col("kind") == "phrase", F.col("idf_sum") * F.col("idf"))
               .otherwise(F.pow(F.col("idf") * F.col("boost"), F.lit(2.0))))
    norm = 1.0 / F.sqrt(F.sum(squares).over(query))
    weight = F.when(F.col("kind") == "phrase", F.pow("idf_sum", F.lit(2.0))).otherwise(
        F.col("idf") * F.col("idf") * F.col("boost")) * norm
    return settle(terms.select(
        "query_id", "k", "kind", "field", "term", "slot", "need", "offset", "n_must",
        "n_counted", "df", "top", _leads().alias("lead"),
        F.when(F.col("occur") == NOT, 0.0).otherwise(weight).alias("weight"),
        *[(F.col("occur") == o).cast("int").alias(f"is_{o}") for o in (MUST, SHOULD, NOT)]))


def _leads() -> Column:
    """True for the terms that decide which documents a query can match at all.

    With MUST clauses these are the rarest token, or all expansions of the rarest fuzzy word;
    without, every SHOULD term.
    """
    query = W.partitionBy("query_id")
    reach = F.when(F.col("kind") == "fuzzy", F.sum("df").over(W.partitionBy("query_id", "slot"))
                   ).otherwise(F.col("df"))
    key = F.struct(reach, F.col("slot"), F.col("offset"))
    rarest = F.min(F.when(F.col("occur") == MUST, key)).over(query)
    return F.when(F.col("n_must") > 0, key == rarest).otherwise(F.col("occur") == SHOULD)


def leads_pay(rows: list[dict] | None, n_docs: int) -> bool:
    """Whether it is less work to look for the leading terms first.

    Directly, every query takes all rows of each of its terms. With leads, each posting is read
    once, and meets only the queries whose leading term is in its document.
    """
    if rows is None:
        return True
    direct = sum(r["df"] for r in rows)
    read = sum({(r["field"], r["term"]): r["df"] for r in rows}.values())
    led = sum(r["df"] for r in rows if r["lead"]) * read / max(1, n_docs)
    return direct >= WORTH_LEADING and 2 * (read + led) < direct


def few_led(rows: list[dict] | None) -> bool:
    """Whether so few documents can match that naming them saves most of the postings."""
    if rows is None:
        return False
    led = sum(r["df"] for r in rows if r["lead"])
    return led <= SPELLED_VALUES and sum(r["df"] for r in rows) - led >= WORTH_NAMING


def term_matches(index: Index, layer: DataFrame, terms: DataFrame,
                 rows: list[dict] | None) -> DataFrame:
    """Postings of the query terms. Few terms reach the Parquet reader as a filter.

    A frequent term that many queries share would multiply its postings by the queries; where
    ``leads_pay``, only documents with a query's leading term are joined with its other terms.
    Where these are few (``few_led``), their ids are looked up first and reach the reader too: it
    then opens their buckets, and of these the pages that hold them, as a term's rows are in the
    order of the ids.
    """
    def postings_of(wanted: list[dict] | None) -> DataFrame:
        return among(among(layer, "field", wanted), "term", wanted)

    def candidates() -> DataFrame:
        leading = None if rows is None else [r for r in rows if r["lead"]]
        leads = terms.filter("lead").select("query_id", "field", "term")
        return (postings_of(leading).join(hinted(leads, rows), ["field", "term"])
                .select("query_id", "doc_id").distinct())

    if few_led(rows):
        named, ids = settle(candidates())
        found = (among(postings_of(rows), "doc_id", ids).join(hinted(named, ids), "doc_id")
                 .join(hinted(terms, rows), ["query_id", "field", "term"]))
    elif leads_pay(rows, index.n_docs):
        asked = terms.select("field", "term").distinct()
        found = (postings_of(rows).join(hinted(asked, rows), ["field", "term"], "left_semi")
                 .join(candidates().hint("shuffle_hash"), "doc_id")
                 .join(hinted(terms, rows), ["query_id", "field", "term"]))
    else:
        found = postings_of(rows).join(hinted(terms, rows), ["field", "term"])
    return found if index.co_located else found.repartition("query_id", "doc_id")


_PER_QUERY = ["n_must", "n_counted", "k"]
_PER_SLOT = ["is_must", "is_should", "is_not", *_PER_QUERY, "doc_len"]


def _slots(matches: DataFrame) -> DataFrame:
    """Plain and fuzzy clauses per document: matched when enough of their terms are there."""
    return (matches.groupBy("query_id", "doc_id", "slot").agg(
        F.count("*").alias("found"), F.max("need").alias("need"),
        F.sum(tf(F.col("tf")) * F.col("weight")).alias("part"),
        *[F.max(c).alias(c) for c in _PER_SLOT])
        .filter("found >= need"))


def phrase_frequency(shifted: Column) -> Column:
    """How often a phrase starts: positions that all its terms share once each is moved back by
    its offset in the phrase."""
    rest = F.slice(shifted, F.lit(2), F.size(shifted))
    return F.size(F.aggregate(rest, F.get(shifted, F.lit(0)), F.array_intersect))


def phrase_matches(matches: DataFrame) -> DataFrame:
    """Phrases per document with their frequency; a group holds one row per token of the phrase."""
    moved = F.transform("positions", lambda p: p - F.col("offset"))
    return (matches.withColumn("moved", moved)
            .groupBy("query_id", "doc_id", "slot").agg(
                F.collect_list("moved").alias("moved"), F.max("need").alias("need"),
                F.max("weight").alias("weight"), *[F.max(c).alias(c) for c in _PER_SLOT])
            .filter(F.size("moved") == F.col("need"))
            .withColumn("freq", phrase_frequency(F.col("moved")))
            .filter("freq > 0"))


def _phrase_slots(matches: DataFrame) -> DataFrame:
    return (phrase_matches(matches)
            .withColumn("part", tf(F.col("freq")) * F.col("weight")))


def scored(index: Index, terms: DataFrame, rows: list[dict] | None) -> DataFrame:
    """``query_id, doc_id, score, k`` of every matching document.

    Layer by layer, as a document lies in one of them: each keeps its own bucketing.
    """
    return reduce(DataFrame.unionByName, [
        _scored_layer(term_matches(index, layer, terms, rows), rows) for layer in index.layers])


def _scored_layer(matches: DataFrame, rows: list[dict] | None) -> DataFrame:
    if rows is None:
        kinds, single = {"plain", "phrase"}, False
    else:
        kinds = {"phrase" if r["kind"] == "phrase" else "plain" for r in rows}
        single = all(r["need"] == 1 and r["kind"] == "plain" for r in rows)
    columns = ["query_id", "doc_id", "part", *_PER_SLOT]
    if single:
        # Each clause is one term, so that a row already stands for a matched clause.
        slots = matches.withColumn("part", tf(F.col("tf")) * F.col("weight")).select(columns)
    elif kinds == {"phrase"}:
        slots = _phrase_slots(matches).select(columns)
    elif "phrase" not in kinds:
        slots = _slots(matches).select(columns)
    else:
        slots = (_slots(matches.filter("kind <> 'phrase'")).select(columns)
                 .unionByName(_phrase_slots(matches.filter("kind = 'phrase'")).select(columns)))
    per_doc = slots.groupBy("query_id", "doc_id").agg(
        F.sum("is_must").alias("must"), F.sum("is_should").alias("should"),
        F.max("is_not").alias("banned"), F.sum("part").alias("total"),
        *[F.max(c).alias(c) for c in [*_PER_QUERY, "doc_len"]])
    matched = ((F.col("must") == F.col("n_must")) & (F.col("banned") == 0)
               & ((F.col("must") > 0) | (F.col("should") > 0)))
    coord = (F.col("must") + F.col("should")) / F.col("n_counted")
    score = F.round(coord * F.col("total") * length_norm(F.col("doc_len")), SCORE_PLACES)
    return per_doc.filter(matched).select("query_id", "doc_id", score.alias("score"), "k")


def top_hits(scores: DataFrame, terms: DataFrame, rows: list[dict] | None) -> DataFrame:
    """The best k per query, by score, then by document id; ``rank`` counts from 1.

    One query takes Spark's bounded top-k. For a batch, the literal bound lets each task drop
    all but the best rows per query before the shuffle.
    """
    order = [F.desc("score"), F.col("doc_id")]
    ranked = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    if rows is not None and len({r["query_id"] for r in rows}) == 1:
        scores = scores.orderBy(*order).limit(rows[0]["k"])
        most = rows[0]["k"]
    elif rows is not None:
        most = max((r["k"] for r in rows), default=0)
    else:
        most = terms.agg(F.max("k")).first()[0] or 0
    return (scores.withColumn("rank", ranked).filter(F.col("rank") <= F.lit(most))
            .filter(F.col("rank") <= F.col("k"))
            .select("query_id", "rank", "doc_id", "score"))


def ranked_documents(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, rank, doc_id, score``: best documents of each query.

    Queries with an error have no rows; ``query_errors`` names them.
    """
    terms, rows = weighted_terms(index, queries)
    probe = early.probe(rows)
    if probe is None or not (few_led(probe) or leads_pay(probe, index.n_docs)):
        return top_hits(scored(index, terms, rows), terms, rows)
    hits, found = settle(_hits(index, terms, probe))
    if found is None:
        return top_hits(scored(index, terms, rows), terms, rows)
    again = early.undecided(probe, found)
    if not again:
        return hits
    late = F.col("query_id").isin(sorted({r["query_id"] for r in again}))
    return hits.filter(~late).unionByName(_hits(index, terms, again))


def _hits(index: Index, terms: DataFrame, rows: list[dict]) -> DataFrame:
    """The best hits for given term rows, which are few."""
    some = terms.sparkSession.createDataFrame(
        [tuple(r[c] for c in terms.columns) for r in rows], terms.schema)
    return top_hits(scored(index, some, rows), some, rows)


def fetch(index: Index, hits: DataFrame, rows: list[dict] | None,
          columns: list[str]) -> DataFrame:
    """Add stored columns of the hit documents.

    Hits that were settled are spelled out: Spark then opens only the buckets that hold them,
    and of these, if there are few, only the row groups and pages. More hits are joined, bucket
    by bucket.
    """
    stored = among(index.docs.select("doc_id", *columns), "doc_id", rows)
    return stored.join(hinted(hits, rows), "doc_id")


def index_search(index: Index, queries: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, path, snippet, score, source`` of the best hits.

    The ranking is computed when this is called, texts are fetched when the result is used.
    With ``live``, a table of existing paths, hits whose file is gone are dropped after the
    limit, so that fewer than k rows may come back; ranks keep their gaps.
    """
    hits, rows = settle(ranked_documents(index, queries))
    if live is not None:
        there = only_live(*settle(fetch(index, hits, rows, ["path"])), live)
        hits, rows = settle(there.drop("path"))
    found = fetch(index, hits, rows, ["path", "text"]).filter(~blank(F.col("path")))
    asked = queries.select("query_id", F.col("text").alias("query_text"), "case_sensitive",
                           "phrase")
    return found.join(asked, "query_id").select(
        "query_id", "rank", "path",
        snippet(F.col("text"), F.col("query_text"), F.col("case_sensitive"),
                F.col("phrase")).alias("snippet"),
        "score", F.lit(SOURCE_INDEX).alias("source"))


def only_live(hits: DataFrame, rows: list[dict] | None, live: DataFrame) -> DataFrame:
    """Hits whose path is in ``live``. Settled hits are looked up by a scan of the large table,
    with their paths in its filter if few; only paths found there are joined back."""
    paths = hinted(hits.select("path"), rows)
    there = among(live.select("path"), "path", rows).join(paths, "path", "left_semi").distinct()
    return hits.join(hinted(there, rows), "path", "left_semi")


def refuse_errors(queries: DataFrame) -> None:
    """Raise ``ValueError`` for the first query that cannot be run."""
    wrong = query_errors(queries).limit(1).collect()
    if wrong:
        raise ValueError(f"query {wrong[0]['query_id']}: {wrong[0]['error']}")
