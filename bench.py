"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the no-op sink (every row is produced, nothing is collected to the
driver), so the time is the plan's execution time, not result transfer.  Tables are laid out in as many files as cores first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "product_mismatch",
    "user_mismatch",
    "dataset_overview",
    "describe_numeric",
    "monthly_product_trend",
    "product_rate_pivot",
    "stratified_split",
    "sample_reviews",
    "clean_text",
    "topic_length_crosstab",
    "lexicon_sentiment",
    "product_stats",
    "term_stats",
    "tfidf",
    "length_histogram",
    "kde_text_length",
    "nearest_centroid",
    "kmeans_topics",
    "stream_ingest",
)


def spread_layout(spark, sf_dir: str, files: int) -> str:
    """The tables as ``files`` Parquet files each (not timed).

    The given ones are one row group apiece, which one task has to read whole; tables on a cluster come in many splits.
    """
    from starlens.session import scratch_path
    from starlens.sources.tables import TABLES

    out = scratch_path(spark, "bench-tables")
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(files).write.parquet(f"{out}/{t}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)

    from starlens.plans.catalog import QUERIES
    from starlens.session import local_session

    spark = local_session(cpus)
    given, sf_dir = sf_dir, spread_layout(spark, sf_dir, int(cpus) if cpus.isdigit() else 8)
    # warm-up: JVM start, code generation caches (not timed)
    QUERIES["rating_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(given.rstrip("/")).replace("sf", "")
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
