"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs).
Each query is planned and run to the end into a sink that discards rows; the figure
is the median of the timed runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from millrace.operators import quality
from millrace.plans.queries import QUERIES, build_fixtures
from millrace.session import clear_scratch, local_session, scratch_path
from millrace.sources import logs, telemetry
from millrace.streaming.medallion import Medallion, run_available

HEADLINE = [
    "batch_kpis",
    "hourly_kpis",
    "device_summary",
    "cleansed",
    "reject_reasons",
    "message_cleansed",
    "message_reject_reasons",
    "latest_silver",
    "table_metrics",
    "topic_lag",
    "topic_metrics",
    "recent_messages",
    "unprocessed_messages",
    "metric_changes",
    "last_n_per_key",
    "merged_feed",
    "device_series",
    "latest_state",
    "layer_readiness",
    "silver_append",
    "stream_silver",
    "context_fields",
    "metrics_long",
    "hourly_stream_kpis",
    "metric_sample_changes",
    "readiness_details",
    "csv_objects",
    "device_recent",
    "latest_stored_silver",
    "paged_feed",
    "polled_metrics",
    "stored_state",
    "stored_validation",
    "stored_stream",
]

#: Objects of the stored log that the last two read.
LOG_FILES = 64


def stored_log(spark, sf_dir: str) -> str:
    """The irregular messages as a log of many files."""
    path = scratch_path(spark, "bench-log")
    events = telemetry.read_events(spark, sf_dir)
    logs.write_log(telemetry.flawed_messages(events).repartition(LOG_FILES), path)
    return path


def stored_queries(path: str) -> dict:
    """Validation and the incremental job over the stored log alone."""

    def validation(spark, _):
        return quality.valid_rows(quality.check_messages(logs.read_log(spark, path)))

    def stream(spark, _):
        tables = Medallion(scratch_path(spark, "bench-tables"))
        run_available(logs.stream_log(spark, path), tables, scratch_path(spark, "bench-progress"))
        return tables.read_silver(spark)

    return {"stored_validation": validation, "stored_stream": stream}


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(cpus, shared=f"file://{shared}")
    build_fixtures(spark, sf_dir)
    known = QUERIES | stored_queries(stored_log(spark, sf_dir))
    seconds = {}
    for name in HEADLINE:
        query = lambda: known[name](spark, sf_dir)
        timed(query)
        seconds[name] = round(statistics.median(timed(query) for _ in range(runs)), 3)
        spark.catalog.clearCache()
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
