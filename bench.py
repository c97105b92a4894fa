"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then BENCH_RUNS times (default 1); the
full result goes to the noop sink and the median is reported.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segmenta.session import session  # noqa: E402
from segmenta.workload import QUERIES  # noqa: E402

HEADLINE = ["orders_by_customer", "orders_to_instrument", "results_round_trip", "rebuilt_messages", "correction_diff", "customer_leaves",
            "document_escapes", "fhir_json_leaves", "lifecycle_breaches", "bed_conflicts", "delivery_replay", "counts_by_channel",
            "retained_messages", "queue_heads"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="20g",
                    spark__sql__shuffle__partitions=str(2 * int(cpus)))
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            t = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(x, 2) for x in times], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
