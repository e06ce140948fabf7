"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from skimmer.plans import catalogue, reports  # noqa: F401  reports adds its queries to the catalogue

HEADLINE = (
    "hll_events_users", "hll_by_group", "hll_native", "bloom_membership", "bloom_fp_rate", "counting_bloom_saturation", "cms_error_report", "cms_heavy_hitters", "topk_exact",
    "hash_chi_square", "chain_probe_cost", "linear_probe_cost", "minhash_signatures", "lsh_candidates", "lsh_verified_pairs", "fh_transform", "fh_collision_curve",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["topk_exact"](spark, folder).collect()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
