"""The registered queries: each calls the library on the driver's tables."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import snippet as S
from corpuslens.functions.text import (
    case_tokens,
    escape_regex,
    file_text,
    flatten_breaks,
    lines,
    split_terms,
)
from corpuslens.operators import filters, match
from corpuslens.operators.bounded import settle, shared_folder
from corpuslens.operators.clauses import query_table, read_queries
from corpuslens.operators.fuzzy import expansions, near_terms
from corpuslens.operators.postings import document_lengths, latest_per_path, token_rows
from corpuslens.plans import catalogue as C
from corpuslens.plans import refresh as R
from corpuslens.plans import retrieve as Q
from corpuslens.plans import scan
from corpuslens.plans.coordinator import index_stats, search
from corpuslens.plans.index import Index, build_index, open_index, save_index
from corpuslens.registry.inputs import (
    ALL_QUERIES,
    FUZZY_WORDS,
    LINE_LITERAL,
    LINE_REGEX,
    NAME_REGEX,
    SIZE_HIGH,
    SIZE_LOW,
)
from corpuslens.schema import FIELD, FIELD_CASE, SearchOptions
from corpuslens.sources.tables import documents, files_view, with_metadata
from corpuslens.sources.tree import files_of, list_tree

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, key: tuple, make: Callable):
    """Build a derived table once per application."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _made:
        _made[full] = make()
    return _made[full]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return files_view(documents(spark, sf))


def meta(spark: SparkSession, sf: str) -> DataFrame:
    return with_metadata(files(spark, sf))


def spoiled(spark: SparkSession, sf: str) -> DataFrame:
    """Files of which every fifth has a NUL at its tenth byte."""
    bytes_ = F.col("content")
    with_nul = F.concat(F.substring(bytes_, 1, 10), F.lit(b"\x00"))
    return meta(spark, sf).withColumn("content", F.when(
        (F.col("doc_id") % 5 == 0) & (F.col("size") > 10), with_nul).otherwise(bytes_))


def previous(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier state of the files: some missing, some with another time, five since gone."""
    shift = (F.when(F.col("doc_id") % 7 == 0, -1).when(F.col("doc_id") % 7 == 1, 1).otherwise(0))
    gone = spark.range(1, 6).select(
        (-F.col("id")).alias("doc_id"),
        F.concat(F.lit("/gone/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("the with of the").alias("text"), F.lit(0).cast("bigint").alias("mtime_us"))
    return (files(spark, sf).filter("doc_id % 10 <> 0")
            .withColumn("mtime_us", F.col("mtime_us") + shift).unionByName(gone))


def index(spark: SparkSession, sf: str) -> Index:
    """The saved index of the documents."""
    return _once(spark, ("index", sf), lambda: save_index(
        spark, files(spark, sf), _folder(spark, "index")))


def refreshed(spark: SparkSession, sf: str) -> tuple[Index, DataFrame]:
    """The index of the earlier state, refreshed by the files as they are."""
    def make():
        root = _folder(spark, "refreshed")
        save_index(spark, previous(spark, sf), root)
        return R.refresh_saved(spark, root, meta(spark, sf))
    return _once(spark, ("refreshed", sf), make)


def tree(spark: SparkSession, sf: str) -> str:
    """The files as real files below a new folder, written by tasks."""
    def make():
        base = re.sub("^file:/+", "/", shared_folder(spark))
        if not os.path.isabs(base):
            raise ValueError(f"a file tree needs a file system every executor sees, not {base}")
        root = os.path.join(base, f"tree-{uuid.uuid4().hex}")

        def write(rows) -> None:
            for row in rows:
                target = root + row["path"]
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as stream:
                    stream.write(row["text"].encode())

        files(spark, sf).select("path", "text").foreachPartition(write)
        return root
    return _once(spark, ("tree", sf), make)


def _below(entries: DataFrame, root: str) -> DataFrame:
    """Paths without the root."""
    return entries.withColumn("path", F.substr("path", F.lit(len(root) + 1)))


def _catalogue(spark: SparkSession, sf: str, rebuilds: int = 1) -> DataFrame:
    def make():
        target = _folder(spark, "catalogue")
        for _ in range(rebuilds):
            C.build_catalogue(spark, tree(spark, sf), target)
        return target
    target = _once(spark, ("catalogue", sf, rebuilds), make)
    return C.open_catalogue(spark, target)


def _entries(spark: SparkSession, sf: str, source: DataFrame) -> DataFrame:
    return _below(source, tree(spark, sf)).select(
        "path", "name", "extension", "size", "is_directory")


def _ask(spark: SparkSession, *query_ids: int) -> DataFrame:
    return query_table(spark, [ALL_QUERIES[i].row(i) for i in query_ids])


def _ranked(spark: SparkSession, sf: str, query_id: int) -> DataFrame:
    return Q.ranked_documents(index(spark, sf), _ask(spark, query_id))


def _scores(spark: SparkSession, sf: str, query_id: int) -> DataFrame:
    ix = index(spark, sf)
    return Q.scored(ix, *Q.weighted_terms(ix, _ask(spark, query_id)))


def _phrases(spark: SparkSession, sf: str, query_id: int) -> DataFrame:
    ix = index(spark, sf)
    terms, rows = Q.weighted_terms(ix, _ask(spark, query_id))
    return Q.phrase_matches(Q.term_matches(ix, ix.postings, terms, rows))


def _scan_options(**more) -> SearchOptions:
    return SearchOptions(search_term=LINE_LITERAL, search_content=True, min_size=SIZE_LOW,
                         max_size=SIZE_HIGH, exclude_extensions=(".BIN",),
                         include_extensions=(".txt", ".md", ".log", ".bin"), **more)


def _flat():
    return flatten_breaks(F.col("text"))


def _no():
    return F.lit(False)


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(FIELD, w) for w in FUZZY_WORDS], "field string, word string")


def _saved_hits(spark: SparkSession, sf: str) -> DataFrame:
    target = _folder(spark, "hits")
    hits, _ = scan.scan_search(meta(spark, sf), SearchOptions(
        search_term=LINE_LITERAL, search_content=True))
    hits.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        root = _folder(spark, "rebuilt")
        save_index(spark, previous(spark, sf), root)
        save_index(spark, files(spark, sf), root)
        return root
    ix = open_index(spark, _once(spark, ("rebuilt", sf), make))
    return ix.postings.groupBy("field", "doc_id").agg(F.max("doc_len").alias("len"))


def _live_hits(spark: SparkSession, sf: str, query_id: int) -> DataFrame:
    ix, _ = refreshed(spark, sf)
    hits = Q.index_search(ix, _ask(spark, query_id), live=files(spark, sf))
    return hits.select("query_id", "rank", "path", "score")


def _fetched(spark: SparkSession, sf: str) -> DataFrame:
    ix = index(spark, sf)
    hits, rows = settle(Q.ranked_documents(ix, _ask(spark, 2)))
    return Q.fetch(ix, hits, rows, ["path", "text"]).select("query_id", "rank", "path", "text")


def _searched(spark: SparkSession, sf: str) -> DataFrame:
    q = ALL_QUERIES[2]
    return search(spark, SearchOptions(search_term=q.text, search_content=True),
                  index=index(spark, sf)).hits


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as one query that wants all its words."""
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), "text", *[
            F.lit(False).alias(c) for c in ("case_sensitive", "fuzzy", "phrase")],
        F.lit(20).alias("k"))
    return Q.ranked_documents(index(spark, sf), queries)


def _modes(spark: SparkSession, sf: str) -> DataFrame:
    """One search for each row of the mode rules: what was searched, counted and said."""
    ix, place = index(spark, sf), "/no/index"
    cases = [
        (False, "index", False, True), (True, "scan", False, True), (True, "index", True, True),
        (True, "auto", True, True), (True, "index", False, False), (True, "auto", False, False),
        (True, "auto", False, True), (True, "index", False, True)]
    parts = []
    for case, (content, mode, regex, present) in enumerate(cases):
        options = SearchOptions(
            search_term="doc1" if not content else LINE_LITERAL, search_content=content,
            content_search_mode=mode, use_regex=regex, content_index_path=place)
        outcome = search(spark, options, files=meta(spark, sf), index=ix if present else None)
        sources = outcome.hits.agg(
            F.count("*").alias("hits"), F.coalesce(F.max("source"), F.lit("")).alias("source"))
        said = "; ".join(f"{level}: {text}" for level, text in outcome.messages)
        parts.append(outcome.stats.join(sources).select(
            F.lit(case).alias("case_id"), "hits", "source", "files_scanned", "matches_found",
            "files_skipped", F.lit(said).alias("said")))
    return reduce(DataFrame.unionByName, parts)


def _fuzzy_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The words of all benchmark texts, each against the whole vocabulary."""
    words = _fuzzy_words(spark, sf).select(F.lit(FIELD).alias("field"), "word").distinct()
    return near_terms(index(spark, sf).vocab, words).select("word", "term", "distance", "df", "cf")


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts as bytes in five encodings with their marks, every seventh with a bad end."""
    text = F.col("text")
    kinds = [(b"\xef\xbb\xbf", text.cast("binary")),
             (b"\xff\xfe", F.encode(text, "UTF-16LE")), (b"\xfe\xff", F.encode(text, "UTF-16BE")),
             (b"\x00\x00\xfe\xff", F.encode(text, "UTF-32")), (b"", text.cast("binary"))]
    which, ends = F.col("doc_id") % len(kinds), [b"\xff", b"\x00\xdc", b"\xdc\x00",
                                                b"\x00\x11\x00\x00", b"\xc3"]
    made = reduce(lambda rest, i: F.when(which == i, F.concat(
        F.lit(kinds[i][0]), kinds[i][1],
        F.when(F.col("doc_id") % 7 == 0, F.lit(ends[i])).otherwise(F.lit(b"")))).otherwise(rest),
        range(len(kinds)), F.lit(None).cast("binary"))
    return documents(spark, sf).select("doc_id", file_text(made).alias("text"))


def _fuzzy_words(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        "item_id", "text", _no().alias("case_sensitive"), F.lit(True).alias("fuzzy"),
        _no().alias("phrase"))
    return (read_queries(items).select("item_id", F.posexplode("clauses").alias("slot", "clause"))
            .select("item_id", "clause.word", "slot"))


def _escaped(spark: SparkSession, sf: str) -> DataFrame:
    """Each whole text, taken as a pattern, matches itself."""
    whole = F.concat(F.lit("^"), escape_regex(F.col("text")))
    return documents(spark, sf).select("doc_id", F.regexp_replace(
        F.concat("text", F.lit("|rest")), whole, F.lit("<>")).alias("rest"))


def _refresh_classes(spark: SparkSession, sf: str) -> DataFrame:
    return R.classify(meta(spark, sf), previous(spark, sf), filters.indexable_metadata())


def _postings(ix: Index) -> DataFrame:
    return ix.postings.select("field", "term", "doc_id", "tf",
                              F.array_join("positions", ",").alias("positions"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    col = F.col
    out = {
        "S1_list_files": lambda s, d: _below(
            files_of(list_tree(s, tree(s, d))), tree(s, d)).select("path", "size"),
        "S2_list_files_for_index": lambda s, d: _below(
            scan.indexable_tree(s, tree(s, d)), tree(s, d)).select("path", "extension", "size"),
        "S3_decode_text": _encoded,
        "S4_catalogue": lambda s, d: _entries(s, d, C.catalogue(s, tree(s, d))),
        "S5_catalogue_rebuild": lambda s, d: _entries(s, d, _catalogue(s, d, 2)),
        "S8_lines": lambda s, d: documents(s, d).select(
            "doc_id", F.posexplode(lines(col("text"))).alias("i", "line")).select(
            "doc_id", (col("i") + 1).alias("line_no"), "line"),
        "S9_saved_index": lambda s, d: index(s, d).terms(),
        "S10_index_rebuild": _rebuilt,
        "S13_saved_hits": _saved_hits,
        "S14_corpus_table": files,
        "F1_size_range": lambda s, d: meta(s, d).filter(
            filters.size_in_range(col("size"), SIZE_LOW, SIZE_HIGH)).select("path", "size"),
        "F2_exclude_extensions": lambda s, d: meta(s, d).filter(
            ~filters.extension_in(col("extension"), [".Log", ".bin"])).select("path"),
        "F3_include_extensions": lambda s, d: meta(s, d).filter(
            filters.extension_in(col("extension"), [".log", ".MD"])).select("path"),
        "F4_binary": lambda s, d: documents(s, d).select("doc_id", filters.is_binary(
            F.concat(col("text").cast("binary"), F.lit(b"\x00"))).alias("is_binary")),
        "F5_index_extensions": lambda s, d: meta(s, d).filter(
            filters.indexable_metadata()).select("path"),
        "F6_index_size": lambda s, d: meta(s, d).filter(
            filters.size_in_range(col("size"), 0, 2000)).select("path", "size"),
        "F7_name_literal": lambda s, d: meta(s, d).select(
            "path", match.name_matches(col("name"), "LOG", False, True).alias("exact"),
            match.name_matches(col("name"), "LOG", False, False).alias("folded")),
        "F8_name_regex": lambda s, d: meta(s, d).filter(
            match.name_matches(col("name"), NAME_REGEX, True, False)).select("path", "name"),
        "F9_line_literal": lambda s, d: files(s, d).filter(
            match.line_contains(col("text"), LINE_LITERAL, False)).select("path"),
        "F10_line_regex": lambda s, d: files(s, d).filter(
            match.line_matches(col("text"), LINE_REGEX, True)).select("doc_id"),
        "F11_existing_hits": partial(_live_hits, query_id=1),
        "F12_skip_reason": lambda s, d: scan.scan_flags(
            spoiled(s, d), _scan_options()).select("path", "skip_reason"),
        "F13_unchanged": lambda s, d: _refresh_classes(s, d)
            .filter("prev_mtime_us IS NOT NULL").select(
            "path", R.unchanged(col("mtime_us"), col("prev_mtime_us")).alias("same")),
        "F14_indexable": lambda s, d: spoiled(s, d).filter(filters.indexable()).select("path"),
        "P1_file_name": lambda s, d: meta(s, d).select("path", "name"),
        "P2_extension": lambda s, d: meta(s, d).select("path", "extension"),
        "P3_file_facts": lambda s, d: meta(s, d).select("path", "size", "mtime_us"),
        "P4_tokens": lambda s, d: token_rows(documents(s, d), FIELD),
        "P5_case_tokens": lambda s, d: token_rows(documents(s, d), FIELD_CASE),
        "P6_query_words": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select(
            "conv_id", "turn", F.explode(split_terms(col("text"))).alias("word")),
        "P7_flat_text": lambda s, d: documents(s, d).select("doc_id", _flat().alias("flat")),
        "P8_anchor": lambda s, d: documents(s, d).select("doc_id", S.anchor(
            _flat(), split_terms(F.lit("with der")), _no()).alias("at")),
        "P9_window": lambda s, d: documents(s, d).select(
            "doc_id", _flat().alias("flat"),
            S.anchor(_flat(), split_terms(F.lit("with")), _no()).alias("at"))
            .filter("at IS NOT NULL").select("doc_id", S.window(
                col("flat"), col("at"), F.lit("with the")).alias("part")),
        "P10_highlight": lambda s, d: documents(s, d).select("doc_id", S.highlight(
            _flat(), split_terms(F.lit("the ou")), _no()).alias("marked")),
        "P11_fallback": lambda s, d: documents(s, d).select("doc_id", S.snippet(
            col("text"), F.lit("zzzzzz"), _no(), _no()).alias("snippet")),
        "P12_snippet": lambda s, d: documents(s, d).select("doc_id", S.snippet(
            col("text"), F.lit("with the"), _no(), _no()).alias("snippet")),
        "P13_fuzzy_words": _fuzzy_words,
        "P14_preview": lambda s, d: documents(s, d).select(
            "doc_id", S.preview(col("text")).alias("preview")),
        "P15_escape": _escaped,
        "P16_labels": lambda s, d: scan.scan_search(meta(s, d), SearchOptions(
            search_term="The", search_content=True, case_sensitive=True))[0],
        "J1_change_class": lambda s, d: _refresh_classes(s, d).select("path", "change_class"),
        "J2_term_lookup": lambda s, d: Q.term_matches(
            index(s, d), index(s, d).postings, *Q.weighted_terms(index(s, d), _ask(s, 2))).select(
            "doc_id", "term", "tf"),
        "J3_phrase_positions": lambda s, d: _phrases(s, d, 3).select(
            "doc_id", F.explode(F.aggregate("moved", F.get(col("moved"), F.lit(0)),
                                            F.array_intersect)).alias("start")),
        "J4_live_hits": partial(_live_hits, query_id=2),
        "J5_not_term": lambda s, d: _scores(s, d, 5).select("doc_id"),
        "J6_near_terms": lambda s, d: near_terms(index(s, d).vocab, _words(s)).select(
            "word", "term", "distance", "df", "cf"),
        "J7_fetched_text": _fetched,
        "A1_postings": lambda s, d: _postings(build_index(files(s, d))),
        "A2_vocabulary": lambda s, d: build_index(files(s, d)).terms(),
        "A2_document_lengths": lambda s, d: document_lengths(documents(s, d)),
        "A3_all_terms": lambda s, d: _scores(s, d, 2).select("doc_id"),
        "A4_scores": lambda s, d: _scores(s, d, 2).select("query_id", "doc_id", "score"),
        "A5_scan_counters": lambda s, d: scan.scan_search(spoiled(s, d), _scan_options())[1],
        "A6_index_counters": lambda s, d: R.refresh_index(
            build_index(previous(s, d)), meta(s, d)).stats,
        "A7_catalogue_count": lambda s, d: C.catalogue_status(C.catalogue(s, tree(s, d))),
        "A8_phrase_frequency": lambda s, d: _phrases(s, d, 3).select("doc_id", "freq"),
        "A9_index_search_counters": lambda s, d: index_stats(
            Q.index_search(index(s, d), _ask(s, 2))),
        "W1_fuzzy_cap": lambda s, d: expansions(index(s, d).vocab, _words(s)).select(
            "word", "term", F.round("boost", 6).alias("boost"), "df"),
        "W2_latest_per_path": lambda s, d: latest_per_path(
            files(s, d).unionByName(previous(s, d))).select("path", "mtime_us"),
        "L1_top_k": lambda s, d: _ranked(s, d, 1).select("doc_id", "score"),
        "L2_rank_order": lambda s, d: _ranked(s, d, 1).select("rank", "doc_id"),
        "U1_upsert": lambda s, d: R.refresh_index(
            build_index(previous(s, d)), meta(s, d)).index.docs.select(
            "path", "mtime_us", F.length("text").alias("n_chars")),
        "E1_scan_search": lambda s, d: scan.scan_search(spoiled(s, d), _scan_options())[0],
        "E2_index_search": lambda s, d: Q.index_search(index(s, d), _ask(s, 2)),
        "E4_search": _searched,
        "E4_modes": _modes,
        "E5_refreshed_index": lambda s, d: refreshed(s, d)[0].terms(),
        "E6_catalogue_status": lambda s, d: C.catalogue_status(_catalogue(s, d)),
        "E7_batch_search": _batch,
        "E7_fuzzy_batch": _fuzzy_batch,
    }
    for query_id, query in ALL_QUERIES.items():
        if query.key:
            out[query.key] = partial(_ranked, query_id=query_id)
    return out
