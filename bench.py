"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from logloom.queries import QUERIES
from logloom.session import builder, prepare

HEADLINE = [
    "kg_flagship", "kg_nodes", "kg_edges", "split_timestamp", "split_timestamp_text", "mask_lines", "templates",
    "templates_text", "parsed_lines", "regex_memory", "fw_params", "dns_params", "audit_params", "vpn_params",
    "rule_state", "fw_events", "alarm_latest", "fifo_join", "farthest_sample", "min_distance", "cond_ops",
]
# Log lines or rows that go into a query, per table, for throughput.
INPUT_TABLE = {"split_timestamp": "events", "mask_lines": "events", "templates": "events", "kg_nodes": "orders", "kg_edges": "orders", "fw_params": "orders"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("logloom-bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    QUERIES["cond_ops"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rates = {}
    for name, source in INPUT_TABLE.items():
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
        rates[name] = round(rows / times[name])
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
