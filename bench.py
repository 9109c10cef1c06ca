"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: input folder (default /root/testdata/sf0.1); BENCH_CPUS: local threads (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = [
    "bin_counts", "runs_select", "asof_lerp", "bin_index", "kde_density", "kde_weighted", "place_fields", "poisson_loglik", "mark_intensity",
    "empirical_movement", "hmm_filter", "hmm_smoother", "viterbi", "em_expected_transitions", "hpd_threshold", "time_rescaling", "gaussian_smooth", "scalar_functions",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.plans import catalogue

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["bin_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
