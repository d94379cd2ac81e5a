"""Times the headline queries on local cores; prints one JSON line.

The purchase-order tables that many queries read are derived first and timed apart ("staging"), so a query's
time is its own. Documents per second are given for what the baseline names: full validation, run
scoring and identifier hints.
"""

from __future__ import annotations

import json
import os
import sys
import time

from poledger import session
from poledger.catalog import load
from poledger.sources import bridge

HEADLINE = ("check_line_arithmetic", "check_totals", "match_line_no", "job_state", "submit_dedupe", "metrics_window")
PER_DOCUMENT = {"validation": "validation_report", "scoring": "group_summary", "hints": "hints_all"}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("poledger-bench", master=f"local[{cpus}]", partitions=int(cpus) * 2)

    start = time.perf_counter()
    for name in bridge.STORED:
        bridge.table(spark, sf, name)
    staging = round(time.perf_counter() - start, 2)
    print("staging", staging, file=sys.stderr, flush=True)

    times = {}
    for name in (*HEADLINE, *PER_DOCUMENT.values()):
        start = time.perf_counter()
        load()[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times[n] for n in HEADLINE), 2)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": sf, "staging_sec": staging,
        "orders": orders, "orders_per_sec": {k: round(orders / times[n]) for k, n in PER_DOCUMENT.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
