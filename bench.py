"""Time the headline queries: ``python bench.py`` prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each time covers the whole query, driver-side preparation included, with every
column of the result computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.check import session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "load_transactions",
    "features",
    "stratified_split",
    "row_index",
    "amount_quantile",
    "log_append",
    "model_metrics",
    "prediction_pivot",
    "disagreement_details",
    "disagreement_count",
    "response_parse",
    "retrieve_topk",
    "retrieve_topk_bucketed",
    "prompt_with_context",
    "embed_text",
    "train_random_forest",
    "train_logistic",
    "batch_respond",
    "full_experiment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and Python workers' machinery before the clock runs.
    QUERIES["model_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
