"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from quern import catalog
from quern.session import build_session

HEADLINE = ("a1_mart", "p6_fact_sales", "w3_sales", "w1_customers", "w2_products", "w4_weather", "a13_profile", "t1_tidy_texts", "s4_pruned_scan", "w5_repeated_lines", "t12_rejected_sales", "v13_invariants", "v11_link_counts")
REPEATS = 2


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark_sql_shuffle_partitions": cpus, "spark_driver_memory": "8g", "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("s4_pruned_scan", "w1_customers"):  # starts the JVM's compilers; not timed
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
