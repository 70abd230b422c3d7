"""Batches and appends that are repeated, broken off, or come from several writers."""

from datetime import datetime, timedelta

import pytest
from plans import plan_text
from pyspark.sql import functions as F

from millrace.operators import monitor, tables
from millrace.schemas import ENVELOPE, OFFSETS, SILVER
from millrace.session import scratch_path
from millrace.sources import logs, telemetry
from millrace.streaming import medallion as m

AT = datetime(2024, 1, 1)


def envelopes(spark, *offsets, partitions=(0,)):
    rows = [(p, o, AT + timedelta(minutes=o), f"{p}-{o}") for o in offsets for p in partitions]
    return spark.createDataFrame(rows, ENVELOPE)


def held(df):
    return sorted((r.partition, r.offset) for r in df.collect())


# several checkpoints


@pytest.fixture(scope="module")
def messages(spark, sf_dir):
    return telemetry.flawed_messages(telemetry.read_events(spark, sf_dir).where("event_id < 600")).cache()


def test_two_checkpoints_keep_all_rows(spark, messages, tmp_path):
    stored = m.Medallion(str(tmp_path / "tables"))
    for name, part in (("a", "offset < 300"), ("b", "offset >= 300")):
        logs.write_log(messages.where(part), str(tmp_path / name))
        counted = m.run_available(logs.stream_log(spark, str(tmp_path / name)), stored, str(tmp_path / f"progress-{name}"))
        assert counted.batches == [0]
    silver, quarantine = stored.read_silver(spark), stored.read_quarantine(spark)
    assert silver.count() + quarantine.count() == 600
    assert silver.select("writer").distinct().count() == 2
    gold = stored.read_gold(spark)
    assert gold.count() == 2 and gold.agg(F.sum("total_events")).first()[0] == silver.count()
    metrics = tables.table_metrics(silver).first()
    assert (metrics.record_count, metrics.snapshot_count, metrics.current_snapshot_id) == (silver.count(), 2, 0)
    totals = stored.run_counters(spark).agg(F.sum("ingested"), F.sum("processed"), F.sum("kpis"), F.sum("batches")).first()
    assert tuple(totals) == (600, silver.count(), 2, 2)


def test_resumed_run_counts_all_its_batches(spark, messages, tmp_path, monkeypatch):
    source, stored = str(tmp_path / "log"), m.Medallion(str(tmp_path / "tables"))
    for i in range(3):
        logs.write_log(messages.where(f"offset % 3 = {i}").coalesce(1), source)
    run = lambda: m.run_available(logs.stream_log(spark, source, 1), stored, str(tmp_path / "progress"))
    real, calls = m.quarantine_rows, []

    def third_breaks(checked):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(checked)

    monkeypatch.setattr(m, "quarantine_rows", third_breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    assert stored.batch_counters(spark).count() == 2
    counted = run()
    assert (counted.ingested, counted.batches) == (600, [0, 1, 2])
    assert stored.read_gold(spark).count() == 1
    assert stored.run_counters(spark).first().batches == 3
    # the run has finished: what comes next is another
    logs.write_log(messages.where("offset < 50").coalesce(1), source)
    assert run().ingested == 50
    assert run() == m.RunCounters()
    assert stored.read_gold(spark).count() == 2


def test_replacement_without_rows_leaves_none(spark, tmp_path):
    row = spark.createDataFrame([("e", "d", AT, 50.0, 1.0, "OK")], SILVER.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    for df in (row, row.where("1 = 0")):
        tables.write_batch(df, str(tmp_path / "t"), SILVER, 3, "w")
    assert tables.scan_latest(spark, str(tmp_path / "t"), SILVER).count() == 0


def test_scan_opens_only_batches_that_can_hold_the_newest(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(6):
        rows = spark.range(10).select(
            F.concat(F.lit(f"{batch}-"), "id").alias("event_id"), F.lit("d").alias("device_id"),
            F.timestamp_add("HOUR", F.col("id") + 8 * batch, F.lit(AT).cast("timestamp_ntz")).alias("timestamp"),
            F.lit(50.0).alias("temperature"), F.lit(1.0).alias("vibration"), F.lit("OK").alias("status"),
        )
        tables.write_batch(rows, path, SILVER, batch, f"w{batch % 2}")
    everything = tables.scan_latest(spark, path, SILVER, None).select("event_id").collect()
    for n in (1, 5, 13, 30, 100):
        found = tables.scan_latest(spark, path, SILVER, n)
        assert [r.event_id for r in found.collect()] == [r.event_id for r in everything[:n]]
    found = tables.scan_latest(spark, path, SILVER, 5)
    found.collect()
    text = plan_text(found)
    assert "dynamicpruning" in text and "GreaterThanOrEqual(timestamp" in text
    files = {r.f.split("/writer=")[1].split("/part")[0] for r in found.select(F.col("_metadata.file_path").alias("f")).distinct().collect()} if "_metadata" in found.columns else None
    assert files is None or files == {"w1/batch_id=5"}


# appends


def test_same_append_twice(spark):
    store = logs.LogStore(scratch_path(spark, "log"), 4)
    for _ in range(2):
        store.append(envelopes(spark, *range(5), partitions=(0, 1)))
    assert store.rows(spark).count() == 10 == store.manifest(spark).agg(F.sum("n")).first()[0]
    offsets = monitor.log_offsets(store.manifest(spark))
    assert monitor.topic_totals(offsets).first().messages_count == 10
    recent = monitor.recent_messages(store.rows(spark), store.manifest(spark), offsets, 4)
    assert held(recent) == [(0, 3), (0, 4), (1, 3), (1, 4)]


def test_append_that_dies_between_its_jobs(spark, monkeypatch):
    store = logs.LogStore(scratch_path(spark, "log"), 4)
    store.append(envelopes(spark, 0, 1))
    real = logs._spans

    def broken(rows):
        if (rows.agg(F.max("offset")).first()[0] or 0) > 1 and broken.live:
            broken.live = False
            return real(rows)  # looked at for crossing blocks; the next call is the manifest
        if not broken.live and not broken.done:
            broken.done = True
            raise RuntimeError("died")
        return real(rows)

    broken.live, broken.done = True, False
    monkeypatch.setattr(logs, "_spans", broken)
    more = envelopes(spark, *range(2, 10))
    with pytest.raises(RuntimeError, match="died"):
        store.append(more)
    assert store.stored(spark).count() == 10
    assert held(store.rows(spark)) == [(0, 0), (0, 1)]
    offsets = spark.createDataFrame([(0, 0, 10, None)], OFFSETS)
    waiting = monitor.unprocessed_messages(store.stored(spark), store.manifest(spark), offsets)
    assert held(waiting) == [(0, 0), (0, 1)]
    store.append(more)
    assert held(store.rows(spark)) == [(0, i) for i in range(10)]


def test_offsets_that_the_log_holds_are_left_out(spark):
    store = logs.LogStore(scratch_path(spark, "log"), 4)
    store.append(envelopes(spark, 0, 1, 2, 6))
    store.append(envelopes(spark, 1, 2, 3, 4, 5, 6, 7), "again")
    assert held(store.rows(spark)) == [(0, i) for i in range(8)]
    assert store.manifest(spark).agg(F.sum("n")).first()[0] == 8
    assert store.append(envelopes(spark, 99), "again") == "again"
    assert store.rows(spark).count() == 8


# consumer groups


def test_limited_reads_take_each_message_once(spark):
    store = logs.LogStore(scratch_path(spark, "log"), 3)
    store.append(envelopes(spark, *range(5), partitions=(0, 1, 2, 3)))
    group, seen = logs.ConsumerGroup(store, "app"), []

    def handle(batch, step):
        rows = held(batch)
        seen.extend(rows)
        sizes.append((step, len(rows)))

    sizes = []
    assert group.take(spark, handle, 7) == 0
    assert {p for p, _ in seen} == {0, 1, 2, 3}
    store.append(envelopes(spark, 5, 6, partitions=(3, 4)))
    while group.take(spark, handle, 7) is not None:
        pass
    assert sizes == [(0, 7), (1, 7), (2, 7), (3, 3)]
    assert sorted(seen) == held(store.rows(spark))
    assert group.take(spark, handle) is None
    # another group begins at the start
    seen.clear()
    assert logs.ConsumerGroup(store, "other").take(spark, handle) == 0
    assert sorted(seen) == held(store.rows(spark))


def test_failed_step_comes_again_as_it_was(spark):
    store = logs.LogStore(scratch_path(spark, "log"), 3)
    store.append(envelopes(spark, 0, 2, 4, 9, partitions=(0, 1)))
    group, got = logs.ConsumerGroup(store, "app"), {}

    def fails(batch, step):
        got["first"] = (step, held(batch))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        group.take(spark, fails, 3)
    store.append(envelopes(spark, 10, 11, partitions=(0, 1, 2)))
    group.take(spark, lambda batch, step: got.update(second=(step, held(batch))), 100)
    assert got["first"] == got["second"] and len(got["first"][1]) == 3
    rest = []
    assert group.take(spark, lambda batch, step: rest.extend(held(batch))) == 1
    assert sorted(rest + got["second"][1]) == held(store.rows(spark))


def test_limited_read_prunes_blocks(spark):
    store = logs.LogStore(scratch_path(spark, "log"), 10)
    store.append(envelopes(spark, *range(100)))
    group, plans = logs.ConsumerGroup(store, "app"), []

    def handle(batch, step):
        batch.collect()
        plans.append(plan_text(batch))

    group.take(spark, handle, 4)
    assert "dynamicpruning" in plans[0]


def test_empty_log_has_nothing_to_take(spark):
    store = logs.LogStore(scratch_path(spark, "log"))
    assert logs.ConsumerGroup(store, "app").take(spark, None, 5) is None
