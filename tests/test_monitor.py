from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import monitor, readiness
from millrace.operators.context import context_document
from millrace.operators.kpis import batch_kpis
from millrace.plans.queries import QUERIES
from millrace.schemas import ENVELOPE, OFFSETS
from millrace.session import scratch_path
from millrace.sources import telemetry
from millrace.sources.logs import LogStore

AS_OF = datetime(2024, 1, 31)


def stored(spark, log, block=100):
    """Rows and manifest of a log appended in blocks."""
    store = LogStore(scratch_path(spark, "test-log"), block)
    store.append(log)
    return store.rows(spark), store.manifest(spark)


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    events = telemetry.read_events(spark, sf_dir)
    return telemetry.bronze_log(telemetry.telemetry_from_events(events)).cache()


@pytest.fixture(scope="module")
def store(spark, log):
    return stored(spark, log)


@pytest.fixture(scope="module")
def offsets(store):
    return telemetry.committed_offsets(monitor.log_offsets(store[1])).cache()


def lag_of(store, offsets):
    return monitor.topic_lag(monitor.partition_lag(*store, offsets), F.lit(AS_OF).cast("timestamp_ntz"))


def test_offsets_are_dense_and_match_the_log(log, store, offsets):
    ends = log.groupBy("partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    derived = monitor.log_offsets(ends, offsets).select(*OFFSETS.names)
    assert {tuple(r) for r in derived.collect()} == {
        tuple(r) for r in offsets.select(*OFFSETS.names).collect()
    }
    assert log.select("partition", "offset").distinct().count() == log.count()


def test_counts_add_up(log, store, offsets):
    m = monitor.topic_metrics(lag_of(store, offsets), "t").first()
    assert m.processed + m.in_queue == m.total_messages == log.count()
    assert monitor.partition_lag(*store, offsets).where("lag < 0").count() == 0


def test_tail_shares(spark, store, offsets):
    got = monitor.recent_messages(*store, offsets, 50)
    counts = {r.partition: r["count"] for r in got.groupBy("partition").count().collect()}
    assert counts == {0: 12, 1: 12, 2: 12, 3: 12}
    few = monitor.recent_messages(*store, offsets, 2)
    assert few.count() == 2


def test_nothing_committed_beyond_the_end(spark, store, offsets):
    ahead = offsets.withColumn("committed_offset", F.col("end_offset") + 5)
    m = monitor.topic_metrics(lag_of(store, ahead), "t").first()
    assert (m.in_queue, m.lag_seconds, m.processing_rate, m.queue_depth_percent) == (0, 0.0, 0.0, 0.0)
    assert m.last_processed_timestamp == m.latest_message_timestamp
    assert monitor.unprocessed_messages(*store, ahead).count() == 0


def test_compacted_log_takes_the_next_message(spark):
    rows = [(0, 0, datetime(2024, 1, 1), "a"), (0, 9, datetime(2024, 1, 2), "b")]
    log = spark.createDataFrame(rows, ENVELOPE)
    offsets = spark.createDataFrame([(0, 0, 10, 4)], OFFSETS)
    row = monitor.partition_lag(*stored(spark, log, 2), offsets).first()
    assert (row.lag, row.oldest_unprocessed) == (6, datetime(2024, 1, 2))


def test_empty_log(spark):
    store = stored(spark, spark.createDataFrame([], ENVELOPE))
    offsets = spark.createDataFrame([], OFFSETS)
    m = monitor.topic_metrics(lag_of(store, offsets), "t").first()
    assert (m.total_messages, m.in_queue, m.lag_seconds, m.queue_depth_percent) == (0, 0, 0.0, 0.0)
    assert monitor.recent_message(*store).count() == 0
    assert monitor.recent_messages(*store, offsets).count() == 0
    assert monitor.unprocessed_messages(*store, offsets).count() == 0


def test_end_offset_tie_goes_to_the_lowest_partition(spark):
    at = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, 3, at, "one"), (0, 3, at, "zero"), (0, 2, at, "no")], ENVELOPE)
    assert monitor.recent_message(*stored(spark, log, 2)).first().value == "zero"


def test_unset_metrics_leave_no_row(spark):
    df = spark.createDataFrame([("t", 1, None)], "topic string, in_queue bigint, lag_seconds double")
    got = [tuple(r) for r in monitor.metric_rows(df, ["topic"]).collect()]
    assert got == [("t", "in_queue", "1", "In Queue")]


EXPECTED = [
    ("bronze", "bucket", "bronze"),
    ("bronze", "topic", "plant.raw"),
    ("silver", "bucket", "silver"),
    ("silver", "table", "silver.plant.cleansed"),
    ("gold", "bucket", "gold"),
    ("gold", "table", "gold.plant.kpis"),
]


@pytest.mark.parametrize(
    "name,found",
    [("silver.plant.cleansed", True), ("plant.cleansed", True), ("cleansed", True),
     ("ant.cleansed", False), ("x.silver.plant.cleansed", False), ("plant%", False)],
)
def test_suffix_rule(spark, name, found):
    expected = spark.createDataFrame(EXPECTED, "layer string, kind string, name string")
    have = [("bucket", b) for b in ("bronze", "silver", "other")] + [
        ("topic", "plant.raw"), ("topic", "raw"), ("table", name), ("table", name)]
    inventory = spark.createDataFrame(have, "kind string, name string")
    layers = readiness.layer_readiness(readiness.reconcile(expected, inventory)).collect()
    assert {r.layer: r.status for r in layers} == {
        "bronze": "ready", "silver": "ready" if found else "missing", "gold": "missing"}
    kept = {tuple(r) for r in readiness.expected_only(inventory, expected).collect()}
    assert kept == {("bucket", "bronze"), ("bucket", "silver"), ("topic", "plant.raw")} | (
        {("table", name)} if found else set())


def test_topic_suffix_is_not_enough(spark):
    expected = spark.createDataFrame([("b", "topic", "plant.raw")], "layer string, kind string, name string")
    inventory = spark.createDataFrame([("topic", "raw")], "kind string, name string")
    assert readiness.reconcile(expected, inventory).first().present is False


def test_score_without_required_services(spark):
    df = spark.createDataFrame(
        [("a", "available", False, "success")],
        "service_name string, status string, required boolean, auth_status string",
    )
    row = readiness.readiness_score(df).first()
    assert (row.score, row.total_required, row.authenticated) == (0, 0, 1)


def test_no_kpi_for_an_empty_batch(spark, sf_dir):
    empty = QUERIES["cleansed"](spark, sf_dir).where("1 = 0")
    assert batch_kpis(empty).count() == 0


def test_kpis_do_not_depend_on_layout(spark, sf_dir):
    valid = QUERIES["cleansed"](spark, sf_dir)
    assert batch_kpis(valid.repartition(1)).collect() == batch_kpis(valid.repartition(7)).collect()


def test_context_with_nothing_in_it(spark, log, store, offsets):
    none = spark.createDataFrame([], "kind string, name string")
    layers = spark.createDataFrame(
        [("gold", "missing", 1, 0)], "layer string, status string, expected bigint, present bigint"
    )
    details = spark.createDataFrame([], "layer string, layer_status string, kind string, name string, status string")
    metrics = monitor.topic_metrics(lag_of(store, offsets), "t")
    silver = spark.createDataFrame([], "event_id string, timestamp timestamp_ntz")
    gold = spark.createDataFrame([], "window_start timestamp_ntz, window_end timestamp_ntz")
    import json

    document = context_document(none, details, layers, metrics, silver, gold)
    parts = {(r.part, r.name): json.loads(r.context) for r in document.collect()}
    doc = parts["summary", ""]
    counts = {"layers": 1, "ready": 0}
    assert doc["dashboard"] == {"topics": 0, "tables": 0, "buckets": 0, "readiness": counts}
    assert doc["silver_layer"]["last_5_records"] == [] == doc["gold_layer"]["last_5_records"]
    assert parts["topic", "t"]["total_messages"] == log.count()
    assert parts["layer", "gold"]["status"] == "missing" and len(parts) == 3


def test_context_of_many_layers_and_topics(spark):
    expected = spark.createDataFrame(
        [(f"l{i}", "bucket", f"b{i}") for i in range(1500)], "layer string, kind string, name string"
    )
    inventory = spark.createDataFrame([("bucket", f"b{i}") for i in range(0, 1500, 2)], "kind string, name string")
    pieces = readiness.reconcile(expected, inventory)
    metrics = spark.createDataFrame(
        [(f"t{i}", i, 0.0, 0.0) for i in range(3)],
        "topic string, total_messages bigint, lag_seconds double, processing_rate double",
    )
    silver = spark.createDataFrame([], "event_id string, timestamp timestamp_ntz")
    gold = spark.createDataFrame([], "window_start timestamp_ntz, window_end timestamp_ntz")
    document = context_document(
        readiness.expected_only(inventory, expected),
        readiness.readiness_details(pieces),
        readiness.layer_readiness(pieces),
        metrics,
        silver,
        gold,
    )
    counts = {r.part: r["count"] for r in document.groupBy("part").count().collect()}
    assert counts == {"summary": 1, "topic": 3, "layer": 1500, "piece": 1500}
    missing = document.where("part = 'piece' AND get_json_object(context, '$.status') = 'missing'")
    assert missing.count() == 750


def test_browsing_keeps_the_message(spark, store, offsets):
    found = monitor.recent_messages(*store, offsets, 8).collect()
    assert all(r.value.startswith('{"event_id":') for r in found) and len(found) == 8
    waiting = monitor.unprocessed_messages(*store, offsets, 5).collect()
    assert [r.offset for r in waiting] == list(range(waiting[0].offset, waiting[0].offset + 5))
    assert monitor.unprocessed_messages(*store, offsets, None).count() == 3190


@pytest.mark.parametrize("limit", [1, 99, 100, 101, 700, 5000])
@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_unprocessed_with_any_limit_and_block(spark, block, limit):
    rows = [(p, o, AS_OF, f"{p}-{o}") for p in range(3) for o in range(0, 300, 1 + p)]
    log = spark.createDataFrame(rows, ENVELOPE)
    offsets = spark.createDataFrame([(0, 0, 300, 250), (1, 0, 299, None), (2, 0, 298, 10)], OFFSETS)
    start = {0: 250, 1: 0, 2: 10}
    want = sorted((p, o) for p, o, *_ in rows if o >= start[p])[:limit]
    got = monitor.unprocessed_messages(*stored(spark, log, block), offsets, limit).collect()
    assert [(r.partition, r.offset) for r in got] == want


def test_other_blocks_are_not_read(spark, store, offsets):
    from plans import plan_text

    found = monitor.recent_messages(*store, offsets, 8)
    found.collect()
    assert "dynamicpruning" in plan_text(found)


def test_appends_add_up(spark):
    store = LogStore(scratch_path(spark, "test-log"), 10)
    for low in (0, 15, 30):
        store.append(spark.createDataFrame([(0, o, AS_OF, "x") for o in range(low, low + 15)], ENVELOPE))
    assert monitor.log_offsets(store.manifest(spark)).first().end_offset == 45
    assert store.manifest(spark).agg(F.sum("n")).first()[0] == 45 == store.rows(spark).count()
