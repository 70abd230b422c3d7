"""Log monitoring: totals, backlog, delay, recent and unprocessed messages.

``manifest`` and ``rows`` are those of ``sources.logs.LogStore``: what a question asks of
the log as a whole comes from the manifest, and messages are read from the blocks that
hold them. ``offsets`` is the table a broker reports (partition, begin_offset, end_offset,
committed_offset), one row per log partition; ``log_offsets`` derives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import metric_label
from ..functions.numbers import round_half_up
from ..functions.times import micros_between
from .ordering import previous, running_sums, time_bucket
from .sizing import measured


def log_offsets(manifest: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """Begin and end offset per partition of a log, with what was committed."""
    ends = manifest.groupBy("partition").agg(
        F.min("first_offset").alias("begin_offset"),
        (F.max("last_offset") + 1).alias("end_offset"),
    )
    if committed is None:
        return ends.withColumn("committed_offset", F.lit(None).cast("bigint"))
    return ends.join(committed.select("partition", "committed_offset"), "partition", "left")


#: What a block of an append is known by, in the rows and in the manifest.
BLOCK = ["append", "partition", "block"]


def seek(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Messages of some blocks of the manifest from an offset on, or up to another.

    blocks: ``BLOCK``, _from, and _to if there is an end. They are written first, and the
    filter on them tells the planner that pruning pays, so that other blocks are skipped.
    """
    ends = [c for c in ("_from", "_to") if c in blocks.columns]
    few = measured(blocks.select(*BLOCK, *ends)).where("block >= 0")
    found = rows.join(few, BLOCK).where(F.col("offset") >= F.col("_from"))
    if "_to" in ends:
        found = found.where(F.col("offset") < F.col("_to"))
    return found.drop("append", "block", *ends)


def blocks_from(manifest: DataFrame, starts: DataFrame) -> DataFrame:
    """Blocks that hold messages at or after each partition's ``_from``."""
    return manifest.join(starts, "partition").where(F.col("last_offset") >= F.col("_from"))


def holding_first(blocks: DataFrame, limit: int, start: DataFrame | None = None) -> DataFrame:
    """Of blocks with ``_from``, those that can hold the first ``limit`` messages of their partition.

    A block is left out when the whole blocks before it hold enough. The block in which the
    messages begin counts for nothing there, as part of it may lie before them. ``start``
    has messages that count before a partition's own: partition, _start.
    """
    own = F.when(F.col("first_offset") >= F.col("_from"), F.col("n")).otherwise(0)
    inside = Window.partitionBy("partition").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum(own).over(inside), F.lit(0)))
    if start is not None:
        blocks = blocks.join(start, "partition").withColumn("_before", F.col("_before") + F.col("_start"))
    return blocks.where(F.col("_before") < limit)


def topic_totals(offsets: DataFrame) -> DataFrame:
    return offsets.agg(
        F.coalesce(F.sum(F.col("end_offset") - F.col("begin_offset")), F.lit(0))
        .cast("bigint")
        .alias("messages_count"),
        F.count(F.lit(1)).alias("partitions"),
    )


def _next_offset() -> Column:
    """First offset a consumer has not processed."""
    return F.coalesce("committed_offset", "begin_offset")


def partition_lag(rows: DataFrame, manifest: DataFrame, offsets: DataFrame) -> DataFrame:
    """Backlog per partition and the time of its first unprocessed message.

    The first message at or after the committed offset is taken, so a compacted log works
    too. Of each partition one block is read.
    """
    side = offsets.withColumn("_next", _next_offset())
    starts = side.select("partition", F.col("_next").alias("_from"))
    after = blocks_from(manifest, starts)
    first = after.groupBy("partition").agg(F.min("block").alias("block"))
    waiting = (
        seek(rows, after.join(first, ["partition", "block"]))
        .groupBy("partition")
        .agg(F.min_by("timestamp", "offset").alias("oldest_unprocessed"))
    )
    latest = manifest.groupBy("partition").agg(F.max("latest").alias("latest_message"))
    return (
        side.join(waiting, "partition", "left")
        .join(latest, "partition", "left")
        .select(
            "partition",
            "begin_offset",
            "end_offset",
            "committed_offset",
            F.col("_next").alias("next_offset"),
            F.greatest(F.lit(0), F.col("end_offset") - F.col("_next")).cast("bigint").alias("lag"),
            "oldest_unprocessed",
            "latest_message",
        )
    )


def topic_lag(lags: DataFrame, as_of: Column) -> DataFrame:
    """Whole-topic backlog and delay at ``as_of``, from per-partition lags."""
    totals = lags.agg(
        F.coalesce(F.sum(F.col("end_offset") - F.col("begin_offset")), F.lit(0))
        .cast("bigint")
        .alias("total_messages"),
        F.coalesce(F.sum("lag"), F.lit(0)).cast("bigint").alias("in_queue"),
        F.min(F.when(F.col("lag") > 0, F.col("oldest_unprocessed"))).alias("oldest_unprocessed"),
        F.max("latest_message").alias("latest_message_timestamp"),
    )
    delay = micros_between(F.col("oldest_unprocessed"), as_of).cast("double") / F.lit(1e6)
    return totals.withColumn(
        "delay_seconds",
        F.coalesce(F.greatest(F.lit(0.0), round_half_up(delay, 2)), F.lit(0.0)),
    )


def topic_metrics(lag: DataFrame, topic: str, invalidated: int | Column = 0) -> DataFrame:
    """Processed count, backlog share and times of a topic.

    ``processing_rate`` is the backlog divided by the delay, as the dashboard
    shows it; it is not a measured throughput.
    """
    delay, queue, total = F.col("delay_seconds"), F.col("in_queue"), F.col("total_messages")
    latest = F.col("latest_message_timestamp")
    back = (F.lit(0) - F.floor(delay * F.lit(1e6) + F.lit(0.5))).cast("bigint")
    invalid = F.lit(invalidated) if isinstance(invalidated, int) else invalidated
    return lag.select(
        F.lit(topic).alias("topic"),
        "total_messages",
        "in_queue",
        (total - queue).alias("processed"),
        invalid.cast("bigint").alias("invalidated_count"),
        "latest_message_timestamp",
        F.when(delay > 0, F.timestamp_add("MICROSECOND", back, latest))
        .otherwise(latest)
        .alias("last_processed_timestamp"),
        delay.alias("lag_seconds"),
        F.when(
            (delay > 0) & (queue > 0), round_half_up(queue.cast("double") / delay, 1)
        )
        .otherwise(F.lit(0.0))
        .alias("processing_rate"),
        F.when(
            total > 0,
            round_half_up(queue.cast("double") / total.cast("double") * F.lit(100.0), 1),
        )
        .otherwise(F.lit(0.0))
        .alias("queue_depth_percent"),
    )


def append_history(manifest: DataFrame) -> DataFrame:
    """How the log grew: per appended block its newest time, its partition and its messages."""
    return manifest.select(F.col("latest").alias("at"), "partition", "n")


def polled_samples(appends: DataFrame, commits: DataFrame, polls: DataFrame, seconds: int = 86_400) -> DataFrame:
    """What a dashboard sees at each poll: messages in the log, processed, and waiting.

    appends: at, partition, n. commits: at, partition, committed_offset, counted from 0; the
    last one at or before a poll holds, of equal times the furthest. polls: at. Every commit
    counts as its step from the one before, so one pass over all three in time order, dealt
    out by spans of ``seconds``, gives all samples. No history is scanned per poll.
    """
    span = time_bucket("at", seconds)
    done = previous(
        commits.select("at", "partition", "committed_offset").distinct(),
        ["partition"], ["at", "committed_offset"], ["committed_offset"], "_last", span,
    )
    step = F.col("committed_offset") - F.coalesce(F.col("_last.committed_offset"), F.lit(0))
    grown = appends.groupBy("at").agg(F.sum("n").alias("ingested"))
    moved = done.groupBy("at").agg(F.sum(step).alias("processed"))
    zero = F.lit(0).cast("bigint")
    marked = polls.select("at", zero.alias("ingested"), zero.alias("processed"), F.lit(True).alias("_poll"))
    rows = (
        grown.select("at", "ingested", zero.alias("processed"), F.lit(False).alias("_poll"))
        .unionByName(moved.select("at", zero.alias("ingested"), "processed", F.lit(False).alias("_poll")))
        .unionByName(marked)
    )
    summed = running_sums(rows, [], ["at", "_poll"], ["ingested", "processed"], span)
    return summed.where("_poll").select(
        "at", "ingested", "processed", (F.col("ingested") - F.col("processed")).alias("waiting")
    )


def metric_rows(metrics: DataFrame, key: list[str]) -> DataFrame:
    """One (metric, label, value) row per metric that is set."""
    names = [c for c in metrics.columns if c not in key]
    text = metrics.select(*key, *[F.col(c).cast("string").alias(c) for c in names])
    return (
        text.unpivot(key, names, "metric", "value")
        .where(F.col("value").isNotNull())
        .withColumn("label", metric_label(F.col("metric")))
    )


def recent_messages(
    rows: DataFrame, manifest: DataFrame, offsets: DataFrame, limit: int = 50
) -> DataFrame:
    """Tail of every partition, newest first, without touching progress.

    Each partition gives an equal share of ``limit`` (at least one). The tail is an
    offset range, as a seek would read: only its blocks are read.
    """
    side = measured(offsets.select("partition", "end_offset"))
    share = max(1, limit // max(1, side.count()))
    tails = side.select("partition", (F.col("end_offset") - share).alias("_from"))
    found = seek(rows, blocks_from(manifest, tails))
    return found.orderBy(F.col("timestamp").desc_nulls_last(), "partition", "offset").limit(limit)


def unprocessed_messages(
    rows: DataFrame, manifest: DataFrame, offsets: DataFrame, limit: int | None = 50
) -> DataFrame:
    """Messages at or after the committed offset, in log order.

    With a limit, only the blocks that can hold the first messages are read.
    """
    starts = offsets.select("partition", _next_offset().alias("_from"))
    blocks = blocks_from(manifest, starts)
    if limit:
        # The manifest is small: a row per block. Partitions are numbered, so they are summed first.
        own = F.when(F.col("first_offset") >= F.col("_from"), F.col("n")).otherwise(0)
        totals = blocks.groupBy("partition").agg(F.sum(own).alias("_all"))
        earlier = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("partition", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
        blocks = holding_first(blocks, limit, totals)
    ordered = seek(rows, blocks).orderBy("partition", "offset")
    return ordered.limit(limit) if limit else ordered


def recent_message(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Last message of the partition with the highest end offset; ties go to the lowest."""
    last = manifest.orderBy(F.col("last_offset").desc(), "partition").limit(1)
    return seek(rows, last.withColumn("_from", F.col("last_offset")))
