"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tempograph.plans.registry import QUERIES

HEADLINE = [
    "snapshot_topology", "degree_in_out", "homophily_by_step", "sym_norm_operator", "sgc_hop2", "sgc_multiscale_k2", "pagerank_fixed20", "clustering_coeff",
    "lag_features_w3", "decay_weights", "average_precision_by_step", "calibrated_threshold", "regime_metrics_rollup", "value_profile_by_label", "mmd_unbiased_pairs",
    "twonn_dim", "dedup_keep_last", "phase_pivot", "parse_names", "session_windows", "lr_static",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["split_counts"](spark, sf_dir).collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        at = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - at, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
