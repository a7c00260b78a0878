"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Each query runs to completion into Spark's ``noop`` sink (every row is
produced, nothing is collected); the reported time per query is the median
of ``$BENCH_REPS`` runs after one warm-up run. Prints one JSON line.

Models are fitted once per application: for the first query that asks for one,
``fits`` has its first run, the fit included.

``BENCH_QUERIES=all`` times every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelspark.plans.catalog import load_all  # noqa: E402
from reelspark.session import build_session  # noqa: E402

HEADLINE = [
    "stat_most_rated", "stat_recent_rated", "stat_avg_score", "stat_genre_topn", "top_most_rated",
    "latest_ratings", "indexed_ratings", "item_features", "item_buckets", "multihot_genres",
    "sample_item_features", "sample_user_features", "watch_sequences", "tfidf_terms",
    "content_similar", "embedding_similar", "embedding_topk", "item_profile", "item_top_ratings",
    "user_profile", "genre_browse", "cold_start_recs", "new_user_index", "recent_k",
    "rerank_scores", "tags_joined", "item2vec", "als_user_recs",
    "als_similar_items", "als_similar_users", "user_recs_fallback", "stream_recs_fallback", "ncf_topn", "factor_recs",
    "stream_rerank", "ncf_trained_topn", "ncf_requests", "user_history", "lookup_items", "topic_filter",
]
#: First queries of their model: the first run fits it.
FITS = ("als_user_recs", "ncf_trained_topn")


def _driver_memory() -> str:
    """60% of physical memory for the local JVM, between 2 GB and 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError):
        return "8g"
    return f"{max(2, min(16, int(total * 0.6 / 2**30)))}g"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "1"))
    spark = build_session(f"local[{cpus}]", app="reelspark-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", _driver_memory())})
    reg = load_all()
    keys = sorted(reg) if os.environ.get("BENCH_QUERIES") == "all" else [
        k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    times: dict[str, float] = {}
    fits: dict[str, float] = {}
    failed: dict[str, str] = {}
    for k in keys:
        runs = []
        try:
            for _ in range(reps + 1):
                t0 = time.perf_counter()
                reg[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
        except Exception as ex:  # noqa: BLE001
            failed[k] = f"{type(ex).__name__}: {str(ex)[:200]}"
            continue
        if k in FITS:
            fits[k] = round(runs[0], 3)
        times[k] = round(statistics.median(runs[1:]) if len(runs) > 1 else runs[0], 3)
        print(f"# {k}: {times[k]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "fits": fits, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
           "cpus": cpus, "reps": reps}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
