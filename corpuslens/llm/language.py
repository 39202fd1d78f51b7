"""Language identification by Bayesian fusion of evidence.

For each page the posterior over languages multiplies

* the likelihood of its text: naive Bayes over hashed letter trigrams of words, tempered to at most
  ``WEIGHT`` words' worth of evidence, since neighbouring words are not independent;
* the likelihood of its declared markup language, from a smoothed table of what pages declare
  whose text speaks one language;
* the prior of its host: counts of its pages' text languages, smoothed towards its address
  suffix, that towards all pages, that towards equal shares. A page's own text does not count in
  its own prior.

``und`` is one of the languages: its trigrams are equally likely, so scripts and strings that no
known language explains go there. A page is accepted if its best language is a known one and has a
posterior of ``ACCEPT`` or more.

The trigram model is fitted on at most ``SAMPLE`` documents with a language, taken by a hash of
their ids, as counts in a table of fixed size. One pass over the pages turns each text into a few
numbers; only these are grouped and joined. Hosts are counted with partial sums, so a host with a
third of all pages is no burden, and the join on hosts is of short rows that Spark may split.

Defined cases: a null text, or one without letters, has no text evidence (the text language is
null and not counted), and the other evidence decides; null or unknown hosts, suffixes and
declarations are values of their own; texts of any length are read whole; repeated rows count
each time; ties go to the first language by name; other columns stay, and the added ones replace
any of the same name. No rows give no rows; without training texts all is ``und``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.batches import Kept, slices
from corpuslens.operators.bounded import checkpointed, hinted, settle

SAMPLE = 8_000
BITS = 15
BINS = 1 << BITS
WEIGHT = 20.0
ACCEPT = 0.5
LEAN_HOST, LEAN_SUFFIX = 10.0, 50.0
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
# Parts of a page that are not its text.
MARKUP = re.compile(r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
ENTITY = re.compile(r"&#?\w{1,10};")
ADDED = ("lang_id", "probability", "accepted", "text_lang", "n_letter_words")


def page_text(html: str) -> str:
    return ENTITY.sub(" ", MARKUP.sub(" ", html))


def trigram_bins(word: str) -> list[int]:
    padded = f"^{word}$"
    return [zlib.crc32(padded[i:i + 3].encode("utf-8", "surrogatepass")) & (BINS - 1)
            for i in range(len(padded) - 2)]


@dataclass
class Model:
    """``losses``: a row of log probabilities for each language; the last one is ``UNKNOWN``."""

    languages: list[str]
    logs: np.ndarray

    def evidence(self):
        """A function from a text to its log likelihoods and its number of words."""
        table = np.ascontiguousarray(self.logs.T.astype(np.float32))
        kept = Kept(lambda word: table[trigram_bins(word)].sum(axis=0).tobytes())

        def of(text: str) -> tuple[np.ndarray, int]:
            words = WORD.findall(text.lower())
            if not words:
                return np.zeros(len(self.languages)), 0
            sums = np.frombuffer(b"".join(map(kept.__getitem__, words)), np.float32)
            total = sums.reshape(len(words), -1).sum(axis=0, dtype=float)
            return total * min(1.0, WEIGHT / len(words)), len(words)
        return of


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages of ``docs`` (``doc_id, text, lang``)."""
    chosen = (docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
              .select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct())
    rows = (docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull())
            .join(F.broadcast(chosen), "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Kept(trigram_bins)
        counts: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                for lang, text in zip(batch.column(1).to_pylist(), texts):
                    mine = counts.setdefault(lang, np.zeros(BINS, np.int64))
                    for word in WORD.findall(text.lower()):
                        mine[bins[word]] += 1
        for lang, mine in counts.items():
            met = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(met), pa.string()), pa.array(met.astype(np.int32)),
                 pa.array(mine[met])], names=["lang", "bin", "n"])

    found = (rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin")
             .agg(F.sum("n").alias("n")).toArrow().to_pylist())
    languages = sorted({r["lang"] for r in found} - {UNKNOWN})
    counts = np.zeros((len(languages), BINS))
    for r in found:
        if r["lang"] in languages:
            counts[languages.index(r["lang"]), r["bin"]] = r["n"]
    share = (counts + 0.01) / (counts.sum(axis=1, keepdims=True) + 0.01 * BINS)
    logs = np.concatenate([np.log(share), np.full((1, BINS), -np.log(BINS))])
    return Model([*languages, UNKNOWN], logs)


def _texts_read(pages: DataFrame, text: str, markup: bool, model: Model) -> DataFrame:
    """The pages with ``n_letter_words``, ``text_lang`` and ``likelihoods`` in place of texts."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pages.schema.fields if f.name != text]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.evidence()
        names = shared.value.languages
        for whole in batches:
            for batch, texts in slices(whole, text):
                found = [of(page_text(t) if markup else t) for t in texts]
                best = [names[int(np.argmax(e))] if n else None for e, n in found]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept),
                     pa.array([n for _, n in found], pa.int64()), pa.array(best, pa.string()),
                     pa.array([e.tolist() for e, _ in found], pa.list_(pa.float64()))],
                    names=[*(f.name for f in kept), "n_letter_words", "text_lang", "likelihoods"])

    return pages.mapInArrow(read, T.StructType([
        *kept, T.StructField("n_letter_words", T.LongType()),
        T.StructField("text_lang", T.StringType()),
        T.StructField("likelihoods", T.ArrayType(T.DoubleType()))]))


def _counts(names: list[str]) -> Column:
    return F.array(*[F.count_if(F.col("text_lang") == n).cast("double") for n in names])


def identify(pages: DataFrame, model: Model, text: str, host: Column, suffix: Column,
             declared: Column, markup: bool = False) -> DataFrame:
    """Add ``ADDED`` to pages; the column ``text`` itself is left out."""
    names = model.languages
    n = len(names)
    kept = [c for c in pages.columns if c not in ADDED and c != text]
    keyed = pages.select(
        F.struct(*[F.col(c) for c in kept]).alias("row_"), F.coalesce(host, F.lit("")).alias(
            "host_"), F.coalesce(suffix, F.lit("")).alias("suffix_"),
        F.coalesce(declared, F.lit("")).alias("declared_"), F.col(text).alias("text_"))
    read = checkpointed(_texts_read(keyed, "text_", markup, model))

    hosts = read.groupBy("host_").agg(_counts(names).alias("host_n"))
    suffixes, few_suffixes = settle(read.groupBy("suffix_").agg(_counts(names).alias("suffix_n")))
    says, few_says = settle(read.groupBy("declared_").agg(_counts(names).alias("says_n")))
    everything = read.agg(_counts(names).alias("c")).first()["c"]
    n_declared = says.count()
    overall = [(c + 1.0) / (sum(everything) + n) for c in everything]
    total = F.array(*[F.lit(float(c)) for c in everything])
    hosts, few_hosts = settle(hosts)
    joined = (read.join(hinted(suffixes, few_suffixes), "suffix_")
              .join(hinted(says, few_says), "declared_")
              .join(hinted(hosts, few_hosts), "host_"))

    def sum_of(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    own = F.array(*[F.coalesce(F.col("text_lang") == name, F.lit(False)).cast("double")
                    for name in names])
    others = joined.withColumn("own", own)
    for c in ("host_n", "suffix_n", "says_n"):
        others = others.withColumn(c, F.zip_with(c, "own", lambda a, b: a - b))
    base = F.array(*[F.lit(p) for p in overall])
    by_suffix = F.zip_with("suffix_n", base, lambda a, p: (a + LEAN_SUFFIX * p) / (
        F.col("suffix_sum") + LEAN_SUFFIX))
    by_host = F.zip_with("host_n", "suffix_p", lambda a, p: (a + LEAN_HOST * p) / (
        F.col("host_sum") + LEAN_HOST))
    # A declaration's likelihood: its share among the pages whose text is in that language.
    heard = F.zip_with("says_n", F.zip_with(total, F.col("own"), lambda a, b: a - b),
                       lambda a, t: (a + 1.0) / (t + float(n_declared)))
    summed = (others.withColumn("suffix_sum", sum_of(F.col("suffix_n")))
              .withColumn("host_sum", sum_of(F.col("host_n")))
              .withColumn("suffix_p", by_suffix).withColumn("prior", by_host)
              .withColumn("heard", heard))
    logs = F.zip_with(F.zip_with("prior", "heard", lambda p, q: F.log(p) + F.log(q)),
                      "likelihoods", lambda a, b: a + b)
    posterior = summed.withColumn("logs", logs).withColumn("top", F.array_max("logs")).withColumn(
        "mass", F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    best = F.array_position("logs", F.col("top")).cast("int")
    lang = F.get(F.array(*[F.lit(x) for x in names]), best - 1)
    probability = 1.0 / sum_of(F.col("mass"))
    return posterior.select(
        *[F.col("row_").getField(c).alias(c) for c in kept], lang.alias("lang_id"),
        probability.alias("probability"),
        ((lang != UNKNOWN) & (probability >= ACCEPT)).alias("accepted"), "text_lang",
        "n_letter_words")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def declared_in(html: Column) -> Column:
    """The primary language that the opening tag, whatever its length, declares, in lower case."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*)", 1)
    found = F.lower(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)
