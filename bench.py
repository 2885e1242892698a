"""Time the headline jobs and print one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from quire.operators import blocks, retrieval
from quire.plans import catalog, search
from quire.session import build_session, fresh_path
from quire.sources import model

# The baseline has: clean, chunk, index, enrichment, search, full retrieval; and the analytics.
HEADLINE = [
    "clean_text",
    "two_level_heading_detection",
    "three_level_heading_detection",
    "chapter_tree_build",
    "semantic_chunk_packing",
    "window_chunking",
    "inverted_index_build",
    "definition_extraction",
    "theorem_extraction",
    "keyword_extraction",
    "simhash_fingerprint",
    "near_duplicate_pairs",
    "exact_deduplication",
    "cooccurrence_edges",
    "bm25_search",
    "substring_fallback",
    "exact_vector_top_k",
    "retrieve",
    "running_correct_rate",
    "latest_attempt_per_quiz",
    "chapter_mastery",
    "learning_overview",
    "activity_calendar",
    "study_plan_allocation",
    "subtree_closure",
    "book_digest",
    "streaming_quiz_state",
]


def stored_index(spark, folder: str) -> dict[str, float]:
    """Building the index and searching it, timed apart."""
    seconds, began = {}, time.time()

    def lap(name: str) -> None:
        nonlocal began
        seconds[name] = round(time.time() - began, 3)
        began = time.time()

    index = blocks.write_index(model.chunks(spark, folder), fresh_path(spark, "index"))
    lap("stored_index_build")
    index.search(search.questions(spark, folder), 5).top.write.format("noop").mode("overwrite").save()
    lap("stored_index_bm25")
    index.substrings(search.questions(spark, folder)).write.format("noop").mode("overwrite").save()
    lap("stored_index_substrings")
    chunks, books, chapters = model.chunks(spark, folder), model.books(spark, folder), model.chapters(spark, folder)
    found = retrieval.retrieve(search.questions(spark, folder), chunks, books, chapters, index)
    found.write.format("noop").mode("overwrite").save()
    lap("stored_index_retrieve")
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    seconds.update(stored_index(spark, folder))
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_jobs_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
