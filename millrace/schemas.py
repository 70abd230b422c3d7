"""Data contracts: the one place that names columns, types and required keys."""

from __future__ import annotations

from pyspark.sql import types as T

_REQ = False  # nullable flag of a required column

ENVELOPE = T.StructType(
    [
        T.StructField("partition", T.IntegerType(), _REQ),
        T.StructField("offset", T.LongType(), _REQ),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("value", T.StringType()),
    ]
)

# Every payload field is read as text: shape checks come first, casts after.
PAYLOAD_TEXT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("temperature", T.StringType()),
        T.StructField("vibration", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

SILVER = T.StructType(
    [
        T.StructField("event_id", T.StringType(), _REQ),
        T.StructField("device_id", T.StringType(), _REQ),
        T.StructField("timestamp", T.TimestampNTZType(), _REQ),
        T.StructField("temperature", T.FloatType(), _REQ),
        T.StructField("vibration", T.FloatType(), _REQ),
        T.StructField("status", T.StringType(), _REQ),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("window_start", T.TimestampNTZType(), _REQ),
        T.StructField("window_end", T.TimestampNTZType(), _REQ),
        T.StructField("total_events", T.LongType(), _REQ),
        T.StructField("avg_temp", T.FloatType(), _REQ),
        T.StructField("anomaly_count", T.IntegerType(), _REQ),
    ]
)

# What the job stores for its KPIs: per run, batch and hour, sums that merge to a GOLD row.
GOLD_PARTIAL = T.StructType(
    [
        T.StructField("run", T.LongType(), _REQ),
        T.StructField("hour_start", T.TimestampNTZType(), _REQ),
        T.StructField("window_start", T.TimestampNTZType(), _REQ),
        T.StructField("window_end", T.TimestampNTZType(), _REQ),
        T.StructField("total_events", T.LongType(), _REQ),
        T.StructField("temp_whole", T.LongType(), _REQ),
        T.StructField("temp_parts", T.LongType(), _REQ),
        T.StructField("anomaly_count", T.LongType(), _REQ),
    ]
)

QUARANTINE = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("raw_value", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType()), _REQ),
    ]
)

OFFSETS = T.StructType(
    [
        T.StructField("partition", T.IntegerType(), _REQ),
        T.StructField("begin_offset", T.LongType(), _REQ),
        T.StructField("end_offset", T.LongType(), _REQ),
        T.StructField("committed_offset", T.LongType()),
    ]
)

# What a batch of the job did, and the run it belongs to.
COUNTERS = T.StructType(
    [
        T.StructField("run", T.LongType(), _REQ),
        T.StructField("ingested", T.LongType(), _REQ),
        T.StructField("processed", T.LongType(), _REQ),
        T.StructField("invalidated", T.LongType(), _REQ),
    ]
)

# Stored tables carry the batch that wrote them and its writer, whose batch numbers they
# are; a writer's batch is a snapshot.
BATCH_COLUMNS = [
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("writer", T.StringType()),
    T.StructField("batch_id", T.LongType()),
]

# Beside a table: rows and times of each stored batch.
BOUNDS = T.StructType(
    [
        T.StructField("low", T.TimestampNTZType()),
        T.StructField("high", T.TimestampNTZType()),
        T.StructField("n", T.LongType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def stored(contract: T.StructType) -> T.StructType:
    """Schema of a contract as it lies on disk, with its batch columns."""
    return T.StructType(list(contract.fields) + BATCH_COLUMNS)
