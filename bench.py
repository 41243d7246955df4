"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores. Every query runs
once to warm up and is then timed. All result rows are produced (no-op sink), and times include
building and planning the query.
"""

from __future__ import annotations

import json
import os
import re
import time

from fleet_health.operators import features, sequences
from fleet_health.plans import views
from fleet_health.plans.queries import REGISTRY
from fleet_health.session import build_session

HEADLINE = """
    ticket_number_int cyclic_time guarded_ratios uptime_hours disk_usage_pct rolling_features
    diff_features netlink_stable zscores features_all labels_from_degradation failure_mode_counts
    latest_reading latest_window sequences_index sequences_labelled sequences_array
    sequences_pooled stratified_split fleet_risk top_risk machine_list fleet_overview
    classification_metrics rul_metrics roc_curve roc_auc metro_dynamic metro_labels ai4i_dynamic
    ai4i_labels epoch_losses
""".split()

TIE = ("l_orderkey", "l_linenumber")


def lineitem_rolling(spark, sf):
    """Rolling statistics over the largest table, few machines with long histories."""
    return features.rolling_features(views.lineitem_dynamic(spark, sf), tie=TIE)


def lineitem_windows(spark, sf):
    return sequences.sequence_index(views.lineitem_dynamic(spark, sf), 48, 12, TIE)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__python__sql__dataFrameDebugging__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: REGISTRY[name] for name in HEADLINE}
    runs |= {f.__name__: f for f in (lineitem_rolling, lineitem_windows)}
    seconds = {}
    for name, function in runs.items():
        for _ in range(2):
            start = time.perf_counter()
            function(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
