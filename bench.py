"""Time the headline queries; prints one JSON line.

Every query runs its whole result into a no-op sink, once to warm up and then once measured. The tables are first rewritten
with a file for each core, outside the measured time.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tripleloom import plans

HEADLINE = (
    "map_events_flat",
    "map_wide",
    "map_orders_nested",
    "map_xml_parts",
    "map_csv_suppliers",
    "map_multi_valued",
    "map_blank_nodes",
    "map_distinct",
    "iri_safe",
    "map_join_condition",
    "map_join_in_message",
    "validate_mixed",
    "serialize_turtle",
    "serialize_jsonld",
    "serialize_joined",
    "serialize_texts",
    "read_ntriples",
    "channel_flow",
    "output_records",
    "channel_stream",
    "channel_state",
    "status_changes",
    "register_channels",
)


# the table whose rows are a query's messages
MESSAGES = {
    "map_events_flat": "events", "map_wide": "events", "map_orders_nested": "orders", "map_xml_parts": "part",
    "map_csv_suppliers": "supplier", "map_multi_valued": "events", "map_blank_nodes": "orders", "map_join_condition": "orders",
    "map_join_in_message": "orders", "serialize_turtle": "events", "serialize_jsonld": "events", "serialize_joined": "orders",
    "serialize_texts": "documents", "channel_flow": "events", "output_records": "events",
}


def split_tables(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The same tables with a file for each core, as tables come in practice: one small file is one task for its reader."""
    out = os.path.join(tempfile.mkdtemp(prefix="bench-"), os.path.basename(sf_dir.rstrip("/")))
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        rows = spark.read.parquet(path)
        rows.repartitionByRange(files, rows.columns[0]).write.parquet(f"{out}/{os.path.basename(path)}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        # recording the Python line of every small expression takes longer than building it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = split_tables(spark, sf_dir, int(cpus))
    registered = plans.queries()
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    rates = {n: round(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() / seconds[n]) for n, t in MESSAGES.items() if n in seconds}
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "messages_per_second": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
