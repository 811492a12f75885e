"""Benchmark of the headline queries. Prints ONE JSON line:

    {"metric": "headline_total", "value": <sec>, "unit": "sec", "queries": {...}, "sf": ...}

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; a query slower than 180 s runs once). Each query is forced
to run completely through the ``noop`` sink; the value is the sum of the per-query
medians. Before EVERY run the session forgets its resolved tables, fitted categories,
written tables and models, so no run reads what an earlier one wrote; only the JVM is warm.
``queries_cold`` holds each query's first run."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_bureau_two_level", "q_installments", "q_wide_features", "q_subset_aggs", "q_corr_gram",
    "q_threshold_sweep", "q_auc", "q_gbt_predict", "q_tree_contrib", "q_stream_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from riskweave.plans import catalog
    from riskweave.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    catalog.load_all()
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("q_app_features")  # warm-up (JIT, file listing)
    times, cold = {}, {}
    for name in only or HEADLINE:
        samples = []
        for i in range(repeat):
            catalog.forget()
            t0 = time.perf_counter()
            run(name)
            samples.append(time.perf_counter() - t0)
            if samples[0] > 180:
                break
        times[name] = round(statistics.median(samples), 3)
        cold[name] = round(samples[0], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "queries_cold": cold, "sf": float(m.group(1)) if m else sf_dir,
           "config": {"master": f"local[{cpus}]", "shuffle_partitions": max(8, 2 * cpus),
                      "aqe": True, "repeat": repeat, "warm": "JVM only", "spark": spark.version}}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
