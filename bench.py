"""Time the headline queries; prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. Each figure is the median of
warm runs in seconds; the index is built once, and its build is a figure of its own.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from corpuslens import build_index, index_search, ranked_documents, save_index  # noqa: E402
from corpuslens.operators import match  # noqa: E402
from corpuslens.operators.clauses import query_table  # noqa: E402
from corpuslens.plans.refresh import refresh_saved  # noqa: E402
from corpuslens.plans.scan import scan_search  # noqa: E402
from corpuslens.registry.session import local_session  # noqa: E402
from corpuslens.schema import SearchOptions  # noqa: E402
from corpuslens.sources.tables import documents, files_view, with_metadata  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", 3))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs: int = RUNS, warm: bool = True) -> float:
    if warm:
        action()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> dict:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", 8), "corpuslens-bench")
    files = files_view(documents(spark, sf))
    meta = with_metadata(files)
    base = tempfile.mkdtemp(prefix="corpuslens-bench-")
    count = [0]

    def place() -> str:
        count[0] += 1
        return f"{base}/{count[0]}"

    def refresh(share: int):
        """Refresh an index after one file in ``share`` got another time (0: none did)."""
        root = place()
        save_index(spark, files, root)
        changed = meta if not share else meta.withColumn(
            "mtime_us", F.col("mtime_us") + (F.col("doc_id") % share == 0).cast("int"))
        start = time.perf_counter()
        refresh_saved(spark, root, changed)
        return round(time.perf_counter() - start, 3)

    queries: dict[str, float] = {}
    queries["B1_literal_scan"] = timed(
        lambda: run(files.filter(match.line_contains(F.col("text"), "getz", False))))
    queries["B2_regex_scan"] = timed(lambda: run(files.filter(
        match.line_matches(F.col("text"), r"^[A-Z][a-z]+ [a-z]+ing\b", True))))
    queries["E1_scan_counters"] = timed(lambda: run(scan_search(
        meta, SearchOptions(search_term="getz", search_content=True))[1]))
    queries["B3_index_build"] = timed(lambda: save_index(spark, files, place()), runs=2)
    queries["A1_postings"] = timed(lambda: run(build_index(files).postings))
    queries["B4_refresh_unchanged"] = refresh(0)
    queries["B4_refresh_tenth"] = refresh(10)

    index = save_index(spark, files, place())

    def search(text: str, case=False, fuzzy=False, phrase=False, k=200):
        asked = query_table(spark, [(1, text, case, fuzzy, phrase, k)])
        return timed(lambda: run(index_search(index, asked)))

    queries["B5_ranked_and"] = search("the with")
    queries["B6_phrase"] = search("of the", phrase=True)
    queries["B7_fuzzy"] = search("wiht", fuzzy=True)
    queries["Q2_or"] = search("getz OR the")
    queries["Q3_not"] = search("the NOT with")
    queries["Q6_case_sensitive"] = search("The", case=True)

    words = [r["term"] for r in index.terms().filter("field = 'content' AND df > 5")
             .orderBy(F.desc("df"), "term").limit(2000).collect()]
    batch = query_table(spark, [
        (i, f"{words[i]} {words[(7 * i + 3) % len(words)]}", False, False, False, 20)
        for i in range(min(1000, len(words)))])
    queries["B8_batch_1000_queries"] = timed(lambda: run(ranked_documents(index, batch)))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), "text", F.lit(False).alias("case_sensitive"),
        F.lit(False).alias("fuzzy"), F.lit(False).alias("phrase"), F.lit(20).alias("k"))
    queries["E7_benchmark_texts"] = timed(lambda: run(ranked_documents(index, items)))
    return {"metric": "total warm time of the headline queries",
            "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
            "sf": sf.rsplit("sf", 1)[-1], "cpus": os.environ.get("BENCH_CPUS", "8"),
            "documents": index.n_docs}


if __name__ == "__main__":
    with contextlib.redirect_stdout(sys.stderr):
        result = main()
    print(json.dumps(result))
