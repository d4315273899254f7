"""Benchmark: run the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through a ``noop`` sink (the full plan
executes, nothing is collected to the driver); times are wall seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitalframe.plans.registry import QUERIES  # noqa: E402
from vitalframe.session import get_session  # noqa: E402

HEADLINE = [
    "flagship_bp_category",
    "C9_clean",
    "F19_features",
    "C8_rejection_report",
    "V12_column_statistics",
    "V8_V11_quality_report",
    "P1_split_counts",
    "P4_standard_scaling",
    "E1_E2_E4_metrics_by_split",
    "E9_threshold_sweep_test",
    "E10_evaluation_bundle_test",
    "K1_score_requests",
    "K9_K16_assessment",
    "K18_what_if",
    "S10_text_report",
    "E12_best_model_test_evaluation",
    "P1_exact_split_counts",
    "P3_kfold_exact_counts",
    "V15_raw_expectations",
    "K20_streaming_scoring",
    "V13_clean_describe",
    "D1_iqr_outlier_filter",
    "K1_tree_model_scoring",
    "K1_boosted_columns_agree",
    "M2_logistic_folds_at_optimum",
    "M12_grid_search",
    "M17_previous_run_as_of",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    # Warm-up (JIT, file listing); not timed.
    QUERIES["flagship_bp_category"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
