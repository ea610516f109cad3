"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from dnsflow.plans.catalog import QUERIES

HEADLINE = [
    "txn_flagship", "txn_by_domain", "match_fifo", "match_unmatched", "match_axfr",
    "ingest_paired_union", "cidr_allow_v4", "cidr_long_list", "geo_country", "txn_enriched",
    "anonymise_counts", "txn_json_rrs", "block_dictionaries", "block_round_trip",
    "query_counters", "query_counters_per_server", "source_entropy", "qps_moving_average",
    "qps_moving_average_minutes", "qps_moving_average_per_server", "stats_report",
    "pending_gauge", "decode_packets", "dnstap_decode", "tcp_sessions", "tcp_framing",
    "parquet_round_trip", "json_round_trip", "stream_stats", "stream_match", "capture_messages",
    "stats_report_full",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("dnsflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Call sites of every column expression are not needed here and slow plan building down.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    # Start the JVM, the code generator and the Python workers before measuring.
    QUERIES["decode_packets"](spark, folder.rsplit("/", 1)[0] + "/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "dns_headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1].strip("/"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
