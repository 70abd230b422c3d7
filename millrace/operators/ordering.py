"""Numbering and look-back inside groups too large for one task.

A plain window sorts each group in one task, so a device with a third of all rows would
be one third of the data in one place. Here a group is dealt out by ``bucket``, an
expression that never falls while the order rises, such as the hour of a time. Rows meet
in their bucket only; one row per bucket tells what lies before it. The width of buckets
changes how the work is split, never the result. One shuffle moves the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_ROWS = 100_000


def time_bucket(time: str, seconds: int) -> Column:
    """Number of the span of this many seconds that a zone-less time falls into."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, F.col(time)) / F.lit(seconds))


def _dealt(df: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """Adds the group as one value that is never null, and the bucket likewise."""
    return df.withColumn("_g", F.struct(F.lit(0).alias("_0"), *group)).withColumn(
        "_b", F.struct(bucket.alias("_1"))
    )


def row_index(
    df: DataFrame, group: list[str], order: list[Column | str], name: str, bucket: Column
) -> DataFrame:
    """Add the 0-based position of each row within its group. ``order`` is total in a group."""
    rows = _dealt(df, group, bucket)
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_g", "_b")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_g", "_b", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_g", "_b").orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, ["_g", "_b"])
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_g", "_b", "_inside", "_start")
    )


def previous(
    df: DataFrame,
    group: list[str],
    order: list[Column | str],
    values: list[str],
    name: str,
    bucket: Column,
) -> DataFrame:
    """Add the ``values`` of the row before, as a struct; null on a group's first row.

    Inside a bucket this is an ordinary lag; a bucket's first row takes the last values
    of the group's bucket before it.
    """
    rows = _dealt(df, group, bucket).withColumn("_now", F.struct(*values))
    carried = (
        rows.groupBy("_g", "_b")
        .agg(F.max_by("_now", F.struct(*order)).alias("_last"))
        .select("_g", "_b", F.lag("_last").over(Window.partitionBy("_g").orderBy("_b")).alias("_carry"))
    )
    back = F.lag("_now").over(Window.partitionBy("_g", "_b").orderBy(*order))
    return (
        rows.withColumn("_back", back)
        .join(carried, ["_g", "_b"])
        .withColumn(name, F.coalesce("_back", "_carry"))
        .drop("_g", "_b", "_now", "_back", "_carry")
    )


def running_sums(
    df: DataFrame, group: list[str], order: list[Column | str], values: list[str], bucket: Column
) -> DataFrame:
    """Replace each of ``values`` by its sum over the group's rows up to this one."""
    rows = _dealt(df, group, bucket)
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_g", "_b").agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)])
    starts = sums.select(
        "_g", "_b", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(values))]
    )
    inside = Window.partitionBy("_g", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return (
        own.join(starts, ["_g", "_b"])
        .withColumns({v: F.col(v) + F.col(f"_s{i}") for i, v in enumerate(values)})
        .drop("_g", "_b", *[f"_s{i}" for i in range(len(values))])
    )


def number_by_id(
    df: DataFrame, group: list[str], key: str, name: str, rows_per_bucket: int = _ROWS
) -> DataFrame:
    """Add a dense 0-based number per group in order of ``key``, an integer unique in it.

    Used once, when a log is appended. The key's range is cut so that buckets hold
    ``rows_per_bucket`` rows on average, however sparse the keys are; that takes a look
    at the key column first.
    """
    seen = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    buckets = max(1, -(-seen.n // rows_per_bucket))
    width = max(1, -(-(seen.high - seen.low + 1) // buckets)) if seen.n else 1
    return row_index(df, group, [key], name, F.floor((F.col(key) - F.lit(seen.low or 0)) / F.lit(width)))
