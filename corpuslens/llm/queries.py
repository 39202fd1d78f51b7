"""The registered queries of this folder; ``oracles`` has the DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import (
    chat,
    collocations,
    decontaminate,
    dual_tree,
    embedding,
    jaccard,
    language,
    licences,
    lm,
    packing,
    quality,
    token_files,
    toxicity,
)
from corpuslens.llm.text import held_out, table
from corpuslens.operators.bounded import hinted, settle

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan_licences(docs, licences.known_digests(spark))
    return found.select("doc_id", "text_digest", "license",
                        F.array_join("notices", ",").alias("notices"), "n_notices")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents that are labelled good, the background all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good, rows = settle(table(spark, sf_dir, "labels").filter("quality = 1")
                        .select("doc_id").distinct().withColumn("good", F.lit(True)))
    flagged = docs.join(hinted(good, rows), "doc_id", "left")
    return lm.score_within(flagged, F.col("good")).select("doc_id", *lm.ADDED)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_documents(docs, model).drop("text")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(planted)))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = language.host_of(F.col("url"))
    declared = language.declared_in(F.col("html"))
    return language.identify(
        pages.withColumns({"host": host, "declared": declared}),
        language.train(table(spark, sf_dir, "documents")), "html", host=F.col("host"),
        suffix=language.suffix_of(F.col("host")), declared=F.col("declared"), markup=True,
    ).select("page_id", "lang_id", "probability", "accepted", "text_lang", "n_letter_words",
             "host", "declared")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.REJECT_BELOW).cast("int").alias("predicted"))


def op8_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_ids(token_files.write_ids(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.rank_documents(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_lm_score": op2_lm_score,
        "op3_toxicity": op3_toxicity,
        "op4_chat_format": op4_chat_format,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_language_id": op6_language_id,
        "op7_quality": op7_quality,
        "op8_embedding_join": op8_embedding_join,
        "op9_packing": op9_packing,
        "op10_decontamination": op10_decontamination,
        "op11_token_files": op11_token_files,
        "op12_lexical_search": op12_lexical_search,
        "op13_collocations": op13_collocations,
    }
