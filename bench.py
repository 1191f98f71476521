"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

One warm-up and three timed runs per query; the median counts.  A run computes
every output row (noop sink), and streaming queries include their replay.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pixelfold.queries import QUERIES  # noqa: E402
from pixelfold.session import build_session  # noqa: E402

HEADLINES = (
    "analyse_series", "stm", "fold_all", "trend_year", "cat_doy", "polarmetrics",
    "interp_linear", "interp_moving", "interp_rbf", "harmonic_fit", "noise_filter",
    "buffer_mask", "distance_to_mask", "impulse_noise", "resample_agg",
    "join_quality", "merge_collections", "catalog_facets", "lut_asof", "stream_nrt", "stream_fold_tumbling",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]", "pixelfold-bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total seconds of the headline queries (median of runs)", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(found.group(1)) if found else None, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
