"""Time the headline queries; prints one JSON line.

Every query runs once to warm up, then the better of two timed runs counts. Inputs are derived
from the given tables inside the timed run, results are produced in full. ``stored`` times the radio
rates over a stored lake, whole and for a window; landing the lake is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "v1_radio_rates",
    "v2_neighbor_counts",
    "v3_wifi_vs_wired",
    "v4_node_wifi_rates",
    "v5_nic_rates",
    "q9_latest_neighbors",
    "q18_device_links",
    "f3_window_radio_rates",
    "e3_device",
    "e8_radio_stats",
    "e12_ip_neighbor",
    "n1_vendor_by_oui",
    "n2_longest_prefix",
    "n6_friendly_names",
    "k1_messages",
    "k3_upsert",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.queries import IN_WINDOW, QUERIES, counters_lake
    from meshlens.plans import stored, views
    from meshlens.sinks import lake

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def best(run) -> float:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        return round(min(runs[1:]), 3)

    seconds = {name: best(lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    landed = counters_lake(spark, sf_dir)
    kept = {
        "v1_radio_rates": best(lambda: views.radio_rates(lake.read_table(spark, landed, "radio_stats"))),
        "f3_window_radio_rates": best(lambda: stored.radio_rates(spark, landed, IN_WINDOW)),
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "stored": kept,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
