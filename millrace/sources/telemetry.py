"""Telemetry and probe inputs derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.times import iso_text
from ..operators.ordering import number_by_id
from .logs import FILES_PER_BATCH

# The plant's devices, in the order of user_id modulo five.
DEVICES = ["CNC-001", "CNC-002", "ROBOT-A", "ROBOT-B", "PRESS-04"]
LOG_PARTITIONS = 4
VIBRATION_STEP = 0.0505

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .parquet(sf_dir)
    )


def reading_rank() -> Column:
    """The counter k inside ``props``."""
    return F.get_json_object("props", "$.k").cast("int")


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Typed readings: one row per event."""
    devices = F.array(*[F.lit(d) for d in DEVICES])
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.element_at(devices, (F.pmod("user_id", F.lit(len(DEVICES))) + 1).cast("int")).alias(
            "device_id"
        ),
        F.col("ts").alias("event_time"),
        F.col("value").alias("temperature"),
        (reading_rank() * F.lit(VIBRATION_STEP)).alias("vibration"),
        F.when(F.col("event_type") == "error", "WARNING").otherwise("OK").alias("status"),
        F.pmod("user_id", F.lit(LOG_PARTITIONS)).cast("int").alias("partition"),
        F.col("event_id").alias("event_number"),
    )


def payload_json() -> Column:
    """JSON message of a typed reading."""
    return F.to_json(
        F.struct(
            "event_id",
            "device_id",
            iso_text(F.col("event_time")).alias("timestamp"),
            "temperature",
            "vibration",
            "status",
        )
    )


def _numbered(readings: DataFrame) -> DataFrame:
    """Readings with a dense offset per log partition, in event number order.

    A producer stores the offset once, when it appends. Here it is derived.
    """
    return number_by_id(readings, ["partition"], "event_number", "offset")


def bronze_log(readings: DataFrame) -> DataFrame:
    """Message envelopes with a dense offset per log partition."""
    return _numbered(readings).select(
        "partition", "offset", F.col("event_time").alias("timestamp"), payload_json().alias("value")
    )


def unnumbered_log(readings: DataFrame) -> DataFrame:
    """Envelopes for a stream, whose offsets ascend but have gaps."""
    return readings.select(
        "partition",
        F.col("event_number").alias("offset"),
        F.col("event_time").alias("timestamp"),
        payload_json().alias("value"),
    )


def committed_offsets(ends: DataFrame) -> DataFrame:
    """Begin, end and committed offset per log partition, as a broker reports them.

    Partitions 0-2 have nine tenths processed; partition 3 was never committed.
    """
    done = F.floor(F.col("end_offset") * F.lit(0.9).cast("double")).cast("bigint")
    return ends.withColumn(
        "committed_offset", F.when(F.col("partition") < LOG_PARTITIONS - 1, done)
    )


def probes_from_events(events: DataFrame) -> DataFrame:
    """Service probe results, one per event: the service is the event type."""
    k = reading_rank()
    return events.select(
        F.concat(F.initcap("event_type"), F.lit(" Service")).alias("description"),
        (F.lit(9000) + k).cast("int").alias("port"),
        (k % 3 != 0).alias("tcp_available"),
        (k % 5 == 0).alias("https_available"),
        F.when(k % 4 == 0, "success").when(k % 4 == 1, "unauthorized").when(k % 4 == 2, "error").alias(
            "auth_status"
        ),
        F.when(k % 7 == 0, "timed out").alias("error"),
        (F.pmod("user_id", F.lit(2)) == 0).alias("required"),
        F.col("ts").alias("checked_at"),
        F.col("event_id").alias("probe_id"),
    )


def flawed_messages(events: DataFrame) -> DataFrame:
    """The log with thirteen kinds of irregular message planted by the counter k.

    0-2 are not one JSON object; 3 lacks a key; 4 and 10 hold text for a number;
    5 holds a number as text; 6 and 11 have no ISO time; 7 has an offset; 8 has a
    null status; 9 an extra key; 12 an hour-precision time.
    """
    readings = telemetry_from_events(events)
    text = F.col("value")
    edits = {
        0: F.lit("not json"),
        1: F.lit("[1,2]"),
        2: F.concat(text, F.lit(" trailing")),
        3: F.regexp_replace(text, ',"status":"[A-Z]+"', ""),
        4: F.regexp_replace(text, '"temperature":[^,]+', '"temperature":"abc"'),
        5: F.regexp_replace(text, '"temperature":([^,]+)', '"temperature":" $1 "'),
        6: F.regexp_replace(text, '"timestamp":"[^"]+"', '"timestamp":"2024"'),
        7: F.regexp_replace(text, r"\+00:00", "+02:00"),
        8: F.regexp_replace(text, '"status":"[A-Z]+"', '"status":null'),
        9: F.regexp_replace(text, r"\}$", ',"line":7}'),
        10: F.regexp_replace(text, '"vibration":[^,]+', '"vibration":"NaN"'),
        11: F.regexp_replace(text, '"timestamp":"[^"]+"', '"timestamp":5'),
        12: F.regexp_replace(text, '"timestamp":"(.{13})[^"]+"', '"timestamp":"$1Z"'),
    }
    value = text
    for k, edited in edits.items():
        value = F.when(F.col("k") == k, edited).otherwise(value)
    return readings.select(
        "partition",
        F.col("event_number").alias("offset"),
        F.col("event_time").alias("timestamp"),
        F.round(F.col("vibration") / F.lit(VIBRATION_STEP)).cast("int").alias("k"),
        payload_json().alias("value"),
    ).select("partition", "offset", "timestamp", value.alias("value"))
