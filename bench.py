"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from voltlake import session
from voltlake.queries import QUERIES

NAMES = [
    "clearing_trend", "spread_summary", "service_summary", "dedup_first_wins", "generation_trend", "eac_block_vwap", "feature_matrix",
    "fleet_series", "fr_schedule", "greedy_backtest", "forecast_trades", "backtest_summary", "mpc_backtest", "forecast_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.build(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["distinct_services"](spark, folder).collect()  # starts the JVM's paths
    took = {}
    for name in NAMES:
        t = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
