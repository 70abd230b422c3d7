from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.feeds import latest
from millrace.operators.kpis import batch_kpis, hourly_kpis
from millrace.operators.quality import check_messages, valid_rows
from millrace.operators.tables import table_metrics
from millrace.schemas import ENVELOPE
from millrace.sources import logs, telemetry
from millrace.streaming import medallion as m


@pytest.fixture(scope="module")
def messages(spark, sf_dir):
    events = telemetry.read_events(spark, sf_dir).where("event_id < 3000")
    return telemetry.flawed_messages(events).cache()


def feed(messages, path, low, high):
    part = messages.where((F.col("offset") >= low) & (F.col("offset") < high))
    logs.write_log(part.coalesce(1), path)


@pytest.fixture
def job(spark, messages, tmp_path):
    source = str(tmp_path / "log")
    tables = m.Medallion(str(tmp_path / "tables"))

    def run(handler=None):
        stream = logs.stream_log(spark, source)
        return m.run_available(stream, tables, str(tmp_path / "progress"))

    return source, tables, run


def test_resume_and_rerun(spark, messages, job):
    source, tables, run = job
    feed(messages, source, 0, 1000)
    first = run()
    assert (first.ingested, first.processed + first.invalidated, first.kpis) == (1000, 1000, 1)
    assert run().ingested == 0
    feed(messages, source, 1000, 3000)
    assert run().ingested == 2000

    silver, quarantine, gold = (
        tables.read_silver(spark), tables.read_quarantine(spark), tables.read_gold(spark))
    assert silver.count() + quarantine.count() == 3000
    checked = valid_rows(check_messages(messages))
    assert silver.select("event_id").exceptAll(checked.select("event_id")).count() == 0
    assert silver.count() == checked.count()
    assert gold.count() == 2
    assert gold.agg(F.sum("total_events")).first()[0] == silver.count()


def test_failed_batch_replays_once(spark, messages, job, monkeypatch):
    source, tables, run = job
    feed(messages, source, 0, 1000)
    real = m.partial_kpis

    def broken(*_):
        raise RuntimeError("lost")

    # silver and quarantine are written, then the batch fails
    monkeypatch.setattr(m, "partial_kpis", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    written = tables.read_silver(spark).count()
    assert written > 0
    monkeypatch.setattr(m, "partial_kpis", real)
    assert run().ingested == 1000
    assert tables.read_silver(spark).count() == written
    assert tables.read_silver(spark).count() + tables.read_quarantine(spark).count() == 1000
    assert tables.read_gold(spark).count() == 1


def test_batch_of_rejects_leaves_no_kpi(spark, job):
    source, tables, run = job
    rows = [(0, i, datetime(2024, 1, 1), "not json") for i in range(5)]
    logs.write_log(spark.createDataFrame(rows, ENVELOPE), source)
    counted = run()
    assert (counted.ingested, counted.processed, counted.invalidated, counted.kpis) == (5, 0, 5, 0)
    assert tables.read_quarantine(spark).count() == 5


def test_second_checkpoint_needs_its_own_numbers(spark, messages, job, tmp_path):
    source, tables, run = job
    feed(messages, source, 0, 1000)
    run()
    later = m.Medallion(tables.root, first_batch=100)
    other = str(tmp_path / "log2")
    feed(messages, other, 1000, 2000)
    m.run_available(logs.stream_log(spark, other), later, str(tmp_path / "progress2"))
    ids = {r.batch_id for r in tables.read_quarantine(spark).select("batch_id").distinct().collect()}
    assert ids == {0, 100}


def test_files_per_batch(spark, messages, tmp_path):
    source = str(tmp_path / "log")
    for i in range(3):
        feed(messages, source, i * 100, i * 100 + 100)
    tables = m.Medallion(str(tmp_path / "tables"))
    counted = m.run_available(
        logs.stream_log(spark, source, files_per_batch=1), tables, str(tmp_path / "progress"))
    assert (counted.ingested, len(counted.batches), counted.kpis) == (300, 3, 1)


def kpi(rows):
    return sorted(tuple(v for k, v in r.asDict().items() if k != "ingested_at") for r in rows)


@pytest.mark.parametrize("files", [1, 4, 1000])
def test_kpis_do_not_depend_on_batches(spark, messages, tmp_path, files):
    source = str(tmp_path / "log")
    logs.write_log(messages.repartition(12), source)
    tables = m.Medallion(str(tmp_path / "tables"))
    counted = m.run_available(logs.stream_log(spark, source, files), tables, str(tmp_path / "progress"))
    assert counted.kpis == 1 and len(counted.batches) == -(-12 // files)
    valid = valid_rows(check_messages(messages))
    want = batch_kpis(valid).first()
    got = tables.read_gold(spark).collect()
    assert len(got) == 1 and (got[0].total_events, got[0].anomaly_count) == (want.total_events, want.anomaly_count)
    assert (got[0].window_start, got[0].window_end) == (want.window_start, want.window_end)
    assert got[0].avg_temp == pytest.approx(want.avg_temp, rel=1e-6)
    assert kpi(tables.read_hourly(spark).collect()) == kpi(hourly_kpis(valid).collect())


def test_nothing_written_reads_as_empty(spark, tmp_path):
    source = str(tmp_path / "log")
    logs.write_log(spark.createDataFrame([], ENVELOPE), source)
    tables = m.Medallion(str(tmp_path / "tables"))
    counted = m.run_available(logs.stream_log(spark, source), tables, str(tmp_path / "progress"))
    assert (counted.ingested, counted.kpis) == (0, 0)
    for read in (tables.read_silver, tables.read_quarantine, tables.read_gold, tables.read_hourly):
        assert read(spark).count() == 0
    assert table_metrics(tables.read_silver(spark)).first().record_count == 0
    assert latest(tables.read_gold(spark), 5).count() == 0


def test_latest_state_on_a_stream(spark, messages, tmp_path):
    from millrace.operators.feeds import newest_per_key

    source = str(tmp_path / "log")
    feed(messages, source, 0, 500)
    stream = newest_per_key(
        logs.stream_log(spark, source).select("partition", "offset", "timestamp"),
        ["partition"], ["offset"])
    query = (
        stream.writeStream.format("memory").queryName("state").outputMode("complete")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r.partition, r.offset) for r in spark.table("state").collect()}
    want = messages.where("offset < 500").groupBy("partition").agg(F.max("offset"))
    assert got == {tuple(r) for r in want.collect()}
