"""Times queries on one machine and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores, BENCH_RUNS how often each query runs
(the best run counts), BENCH_QUERIES a comma-separated choice of queries or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rubrika.plans.catalog import QUERIES
from rubrika.session import build_session

HEADLINE = (
    "categorize_and_log clean_documents clean_pages combine_title_body token_counts vocab_build "
    "encode_fixed_length nb_model predict_nb predict_encoded scores_ranked eval_accuracy predict_lr "
    "softmax_scores vector_score log_validate log_append category_stats daily_volume "
    "recent_predictions recent_from_log history_preview stream_score_log stream_category_stats "
    "stream_daily_volume"
).split()

# The table a query works through, for its rows per second.
SOURCE = {
    "clean_pages": "pages",
    "clean_urls": "pages",
    "reject_blank": "pages",
    "label_lookup": "embeddings",
    "softmax_scores": "embeddings",
    "vector_score": "embeddings",
    "vector_score_columns": "embeddings",
    **dict.fromkeys(
        (
            "label_inverse log_validate log_append log_rejected category_stats daily_volume "
            "stats_views recent_predictions recent_by_sql recent_from_log stream_category_stats "
            "stream_daily_volume stream_daily_volume_late"
        ).split(),
        "events",
    ),
}


def run(spark, query, sf_dir: str) -> float:
    """Seconds from the call to the last row, each row computed and dropped."""
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "rubrika-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = ("documents", "pages", "embeddings", "events")
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables}
    seconds = {}
    for name in names:
        seconds[name] = round(min(run(spark, QUERIES[name], sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total seconds of the queries, best run of each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
        "rows_per_sec": {
            n: round(rows[SOURCE.get(n, "documents")] / max(s, 1e-3)) for n, s in seconds.items()
        },
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
