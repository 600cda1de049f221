"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tidemark.plans.catalog import QUERIES

HEADLINE = (
    "pit_latest", "pit_history", "restatements", "disclosure_summary", "universe_gate", "naive_trap", "attach_shares", "ttm_panel", "signal_mom_12_1", "signal_total_vol_60d",
    "signal_turnover", "signal_bm_ratio", "signal_ep_ratio", "signal_roe", "signal_asset_growth", "vintage_comparison", "clean_cross_section", "labelled_panel", "quantile_returns",
    "information_coefficient", "fama_macbeth", "protocol_summary", "ingest_facts",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", f"{scratch}/local")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["column_coverage"](spark, sf_dir).collect()  # starts the JVM's compilers and touches the files
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
