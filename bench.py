"""Benchmark: wall time of the headline queries over $BENCH_SF_DIR.

Each query is executed in full with a ``noop`` write (every row is
produced, nothing is collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_features",
    "daily_rollup",
    "describe",
    "discount_ranges",
    "rolling_lagged",
    "expanding_store",
    "since_high",
    "lag7_percentile",
    "rolling_rank30",
    "median90",
    "region_weekday_std",
    "lag_exact_date",
    "hist_tail_stats",
    "same_doy_3y",
    "avg_fallback",
    "yoy_fallback",
    "interactions",
    "tiers",
    "store_month_stats",
    "drop_leverage",
    "corr_pairs",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from tillcast.plans import catalog
    from tillcast.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="tillcast-bench")
    qs = catalog.queries()
    names = only or [n for n in HEADLINE if n in qs]
    # warm-up: JVM, parquet footers, codegen caches
    qs["daily_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for n in names:
        t0 = time.time()
        try:
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001  (one failing query must not hide the other timings)
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{n}: {times.get(n, 'failed')}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
