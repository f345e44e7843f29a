"""Time the headline queries after one warm-up pass and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from faultspark.plans import load_all  # noqa: E402
from faultspark.plans.registry import Tables  # noqa: E402

HEADLINE = ["changed_before_trigger", "series_stats", "segments", "cusum_page", "detuning", "derivative_features", "join_ground_truth",
            "quality_gate", "stratified_split", "correlation_matrix", "winsorize", "knn_training", "isolation_forest", "roc_auc",
            "label_agreement_per_label", "single_feature_leak_scan", "random_forest", "header_distributions"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("faultspark-bench")
             .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry, tables = load_all(), Tables(spark, folder)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        registry[name].build(tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    for name in HEADLINE:  # class loading and code generation are not part of any query
        run(name)
    seconds = {name: run(name) for name in HEADLINE}
    # all features of every recording, beside the total
    recordings = tables.events.select("user_id").distinct().count()
    extraction = run("extract_features")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "extract_features_sec": extraction, "recordings_per_sec": round(recordings / extraction, 3), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
