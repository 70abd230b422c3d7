"""Latest rows, bounded histories and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import previous

_TASK_GROUPS = 256


def latest(df: DataFrame, limit: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """Newest rows first by ``timestamp``, else by ``window_start``, else as they come.

    No limit (None or 0) returns everything. ``tie`` columns, ascending, make equal times stable.
    """
    time = next((c for c in ("timestamp", "window_start") if c in df.columns), None)
    if time:
        df = df.orderBy(F.col(time).desc_nulls_last(), *(tie or []))
    return df.limit(limit) if limit else df


def last_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order`` (newest first when descending).

    Every task keeps at most ``n`` rows per key before the shuffle. With very many
    tasks that is still much for one key, so tasks are first merged in groups, and
    the last step sees at most ``n`` rows per key and group.
    """
    grouped = df.withColumn("_group", F.spark_partition_id() % _TASK_GROUPS)
    part = Window.partitionBy(*key, "_group").orderBy(*order)
    whole = Window.partitionBy(*key).orderBy(*order)
    few = grouped.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
    return (
        few.drop("_group")
        .withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )


def newest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert view: of each key only the row greatest by ``order``.

    Equal ``order`` goes to the row whose other columns, as they come, are greatest, so
    the answer does not depend on the order of the rows. A null key is a key. An
    aggregate rather than a window, so copies collapse before the shuffle. Works on a
    stream in update or complete mode.
    """
    rest = [c for c in df.columns if c not in key]
    rank = [*order, *(c for c in rest if c not in order)]
    row = F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(rank)]))
    return (
        df.groupBy(*key)
        .agg(row.alias("_row"))
        .select(*key, *[F.col(f"_row._{rank.index(c)}").alias(c) for c in rest])
        .select(*df.columns)
    )


def merge_feed(seen: DataFrame, page: DataFrame, key: str | None, time: str, n: int) -> DataFrame:
    """Append a page to a feed, skip rows already in it, keep the newest ``n``.

    ``key`` identifies a row, null being a key like others; None compares whole rows.
    Equal times are ordered by key, or else by the remaining columns, largest first.

    Only rows that are not older than the last of the first ``n`` keys go further, and the
    scans are told so; where that time lies is looked up when this is called.
    """
    both = seen.unionByName(page)
    identity = [key] if key else both.columns
    newest = [F.col(c).desc_nulls_last() for c in [time, *(c for c in identity if c != time)]]
    if key is None:
        return both.dropDuplicates().orderBy(*newest).limit(n)
    since = _time_of_first(both, key, time, n)
    if since is not None:
        both = both.where(F.col(time) >= F.lit(str(since)).cast(both.schema[time].dataType))
    return newest_per_key(both, [key], [time]).orderBy(*newest).limit(n)


#: Rows looked at for each key wanted, before all keys are.
_LOOK = 4


def _time_of_first(df: DataFrame, key: str, time: str, n: int) -> object:
    """A time from which on there are ``n`` keys; None if there are fewer, or without a time.

    The newest few rows mostly have enough keys: each task sends only these. Otherwise the
    newest time of every key is compared.
    """
    rows = df.select(key, time).where(F.col(time).isNotNull())
    for some in (rows.orderBy(F.col(time).desc()).limit(_LOOK * n), rows):
        tops = some.groupBy(key).agg(F.max(time).alias(time)).orderBy(F.col(time).desc()).limit(n)
        held, since = tops.agg(F.count(F.lit(1)), F.min(time)).first()
        if held >= n:
            return since
    return None


def drop_unchanged(
    samples: DataFrame, key: list[str], order: list[str], values: list[str], bucket: Column
) -> DataFrame:
    """Drop a sample whose ``values`` equal those of the sample before it.

    ``bucket`` splits a key's samples, as ``ordering.previous`` says.
    """
    compared = previous(samples, key, order, values, "_before", bucket)
    now = F.struct(*values)
    return compared.where(~F.col("_before").eqNullSafe(now)).drop("_before")
