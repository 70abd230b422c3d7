import math
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions.labels import lag_band, metric_label, probe_message, probe_status, service_key
from millrace.functions.numbers import exact_mean, kilobytes, parse_number, round_half_up
from millrace.functions.times import from_epoch_millis, iso_text, parse_iso


def apply(spark, fn, values, kind):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


ISO = [
    "2024-01-01",
    "2024-01-01T05",
    "2024-01-01T05Z",
    "2024-01-01T05+02",
    "2024-01-01T05+02:00",
    "2024-01-01T05:06",
    "2024-01-01 05:06-05:30",
    "2024-01-01T05:06+0200",
    "2024-01-01T05:06:07",
    "2024-01-01T05:06:07.5",
    "2024-01-01T05:06:07.123456Z",
    "2024-01-01T05:06:07.123456+02:00",
    "2024-01-01 05:06:07-0530",
    "2024-02-29T23:59:59.999999+00:00",
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_iso_as_python_reads_it(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = apply(spark, parse_iso, ISO, "string")
        texts = apply(spark, lambda c: iso_text(parse_iso(c)), ISO, "string")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

    def python(text):
        t = datetime.fromisoformat(text)
        return t.astimezone(timezone.utc) if t.tzinfo else t.replace(tzinfo=timezone.utc)

    assert got == [python(t).replace(tzinfo=None) for t in ISO]
    assert texts == [python(t).isoformat() for t in ISO]


def test_numbers(spark):
    good = ["5", "-5.25", "+.5", "5.", "1e3", " 7 ", "1E-2", "007"]
    assert apply(spark, parse_number, good, "string") == [float(g) for g in good]
    bad = ["5d", "NaN", "Infinity", "true", "", " ", "1_0", "0x10", "1e", ".", "5 5", None]
    assert apply(spark, parse_number, bad, "string") == [None] * len(bad)


def test_epoch_millis(spark):
    got = apply(spark, from_epoch_millis, [0, None, 1704067200123, -1], "bigint")
    assert got == [
        None,
        None,
        datetime(2024, 1, 1, 0, 0, 0, 123000),
        datetime(1969, 12, 31, 23, 59, 59, 999000),
    ]


def test_rounding(spark):
    assert apply(spark, lambda c: round_half_up(c, 2), [1.005, 2.345, -1.5, 0.125], "double") == [
        math.floor(v * 100 + 0.5) / 100 for v in [1.005, 2.345, -1.5, 0.125]
    ]
    assert apply(spark, kilobytes, [0, 1024, 1536, 10_000], "bigint") == [0.0, 1.0, 1.5, 9.77]


def test_bands(spark):
    got = apply(spark, lag_band, [0.0, 4.99, 5.0, 29.99, 30.0], "double")
    assert got == ["Real-time"] * 2 + ["Minor delay"] * 2 + ["Significant lag"]


def test_names(spark):
    got = apply(
        spark,
        metric_label,
        ["lag_seconds", "latest_message_timestamp", "topic", "a_timestamp_b_timestamp"],
        "string",
    )
    assert got == ["Lag Seconds", "Latest Message", "Topic", "A B Timestamp"]
    assert apply(spark, service_key, ["Object Store", "Kafka REST API"], "string") == [
        "object_store",
        "kafka_rest_api",
    ]


PROBES = [
    ("down", False, False, "success", "missing"),
    ("down", True, False, "success", "available"),
    ("down", True, False, "unauthorized", "misconfigured"),
    (None, True, False, "error", "available"),
    (None, False, True, None, "available"),
    (None, False, False, None, "missing"),
    ("", False, False, "success", "available"),
    (None, None, None, "unknown", "missing"),
]


def test_probe_status(spark):
    df = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(PROBES)],
        "i int, error string, tcp boolean, https boolean, auth string, want string",
    )
    got = df.select(
        "want",
        probe_status(df.error, df.tcp, df.https, df.auth).alias("got"),
        probe_message(df.error, F.lit(9092), df.auth).alias("message"),
        "error",
        "auth",
    ).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert [r.message for r in got] == [
        r.error or f"Port 9092 - {r.auth or 'unknown'}" for r in got
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_mean_ignores_layout(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    means = {df.repartition(n).agg(exact_mean(F.col("v"))).first()[0] for n in (1, 3, 7)}
    assert len(means) == 1
    assert math.isclose(means.pop(), math.fsum(values) / len(values), abs_tol=1e-6)


def test_mean_of_many_large_values(spark):
    df = spark.range(1_000_000).select((F.col("id") % 90 + 1_000_000.5).alias("v"))
    exact = sum(i % 90 + 1_000_000.5 for i in range(1_000_000)) / 1_000_000
    assert df.agg(exact_mean(F.col("v"))).first()[0] == exact
