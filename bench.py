"""Time the headline queries on the larger tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from scatterframe.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "I1_block", "I7_diagonal", "I24_perm_valid",
    "B1_runs", "B6_every_start", "B9_clean_region", "B10_block_failure",
    "E1_block_loads", "E4_delta_gini", "E11_trial_stats",
    "G4_dispersion", "G5_spread_factor", "G8_b_guar", "G9_apsr", "G11_block_distances", "G12_laplacian_energy", "G16_pairwise_distance",
    "L5_gini_load", "L6_es_load", "L7_design_cells",
    "K2_zscore_all", "K5_kpi_summary", "K17_density_ratio",
    "R1_cell_means", "R4_fisher_combine", "R5_spearman_trials", "R10_within_block_matrix", "R18_block_bootstrap",
    "Q1_hazen_percentile", "A1_anova_two_way", "H1_cell_occupancy", "H5_kpi_reconstruction", "HA3_outliers", "F3_balanced_shape",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session before the clock
    times = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
