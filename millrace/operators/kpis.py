"""KPI aggregates over valid readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import exact_mean, mean_of_parts, mean_parts, round_half_up
from .feeds import last_n
from .ordering import row_index, time_bucket

WARNING = "WARNING"


def kpi_measures(time: str) -> list[Column]:
    """Counts stay long here; only the stored table narrows the anomaly count."""
    return [
        F.min(time).alias("window_start"),
        F.max(time).alias("window_end"),
        F.count(F.lit(1)).alias("total_events"),
        round_half_up(exact_mean(F.col("temperature")), 2).alias("avg_temp"),
        F.count_if(F.col("status") == WARNING).alias("anomaly_count"),
    ]


def batch_kpis(readings: DataFrame, time: str = "event_time") -> DataFrame:
    """One KPI row for the whole input, or none when it is empty."""
    return readings.agg(*kpi_measures(time)).where("total_events > 0")


def hourly_kpis(readings: DataFrame, time: str = "event_time") -> DataFrame:
    """One KPI row per hour; the window columns are the first and last reading in it."""
    return (
        readings.groupBy(F.window(time, "1 hour").alias("hour"))
        .agg(*kpi_measures(time))
        .select(
            F.col("hour.start").alias("hour_start"),
            "window_start",
            "window_end",
            "total_events",
            "avg_temp",
            "anomaly_count",
        )
    )


def device_summary(readings: DataFrame, time: str = "event_time") -> DataFrame:
    """KPI measures per device, with first and last reading time."""
    return (
        readings.groupBy("device_id")
        .agg(*kpi_measures(time))
        .withColumnsRenamed({"window_start": "first_seen", "window_end": "last_seen"})
    )


def recent_series(readings: DataFrame, key: str, order: list[str], values: list[str], n: int) -> DataFrame:
    """Per key its newest ``n`` readings as one array, oldest first, and how many there are.

    ``order`` is total within a key. Each task sends ``n`` rows of a key at most, so an
    array is bounded whatever a key's readings are. An entry holds ``order``, then ``values``.
    """
    few = last_n(readings.select(key, *order, *values), [key], [F.col(c).desc_nulls_last() for c in order], n)
    entries = F.array_sort(F.collect_list(F.struct(*order, *values)))
    return few.groupBy(key).agg(F.count(F.lit(1)).alias("n"), entries.alias("series"))


#: Columns of a partial KPI. Partials of any split of the readings merge to the same KPI.
PARTIAL = ["window_start", "window_end", "total_events", "temp_whole", "temp_parts", "anomaly_count"]


def partial_kpis(readings: DataFrame, time: str = "event_time") -> DataFrame:
    """Sums and bounds per hour that later partials can be added to."""
    whole, parts = mean_parts(F.col("temperature"))
    return readings.groupBy(F.date_trunc("HOUR", F.col(time)).cast("timestamp_ntz").alias("hour_start")).agg(
        F.min(time).alias("window_start"),
        F.max(time).alias("window_end"),
        F.count(F.lit(1)).alias("total_events"),
        F.sum(whole).alias("temp_whole"),
        F.sum(parts).alias("temp_parts"),
        F.count_if(F.col("status") == WARNING).alias("anomaly_count"),
    )


def merged_kpis(partials: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """KPI rows from partials, one per value of ``by``."""
    merged = partials.groupBy(*by).agg(
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.sum("total_events").alias("total_events"),
        F.sum("temp_whole").alias("_whole"),
        F.sum("temp_parts").alias("_parts"),
        F.sum("anomaly_count").alias("anomaly_count"),
        *more,
    )
    mean = mean_of_parts(F.col("_whole"), F.col("_parts"), F.col("total_events"))
    return merged.withColumn("avg_temp", round_half_up(mean, 2)).drop("_whole", "_parts")


def label_windows(kpis: DataFrame, order: list[str]) -> DataFrame:
    """Name KPI rows W1, W2, ... in time order."""
    month = time_bucket(order[0], 30 * 86_400)
    return row_index(kpis, [], order, "_n", month).select(
        F.concat(F.lit("W"), (F.col("_n") + 1).cast("string")).alias("label"), *kpis.columns
    )


def device_series(
    readings: DataFrame, devices: list[str], order: list[str], seconds: int = 86_400
) -> DataFrame:
    """Temperatures side by side: row i holds the i-th reading of every device.

    The device list is known, so one conditional aggregate does; a pivot would
    shuffle the rows twice. The first column of ``order`` is a time; readings are
    numbered in spans of ``seconds``.
    """
    rows = readings.select("device_id", "temperature", *order)
    numbered = row_index(rows, ["device_id"], order, "idx", time_bucket(order[0], seconds))
    return numbered.groupBy("idx").agg(
        *[F.max(F.when(F.col("device_id") == d, F.col("temperature"))).alias(d) for d in devices]
    )
