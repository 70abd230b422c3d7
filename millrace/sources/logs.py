"""Message logs in files: publish, batch read and incremental read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.feeds import last_n
from ..operators.monitor import BLOCK, blocks_from, holding_first, seek
from ..operators.quality import decode_value
from ..operators.tables import read_table
from ..schemas import ENVELOPE
from ..session import saved

FILES_PER_BATCH = 1000

MANIFEST = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("first_offset", T.LongType()),
        T.StructField("last_offset", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("latest", T.TimestampNTZType()),
        T.StructField("append", T.StringType()),
    ]
)
BLOCKED = T.StructType([*ENVELOPE.fields, T.StructField("append", T.StringType()), T.StructField("block", T.LongType())])

#: Planned reads of consumer groups: of each partition the messages from an offset up to another.
RANGES = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("from_offset", T.LongType()),
        T.StructField("next_offset", T.LongType()),
        T.StructField("step", T.LongType()),
    ]
)


def publish(
    rows: DataFrame, path: str, limit: int | None = None, per_object: int = 100_000
) -> None:
    """Append rows to a log as JSON lines; no limit publishes all.

    An object holds ``per_object`` lines at most, so that it can be read as one text.
    """
    if limit:
        rows = rows.limit(limit)
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    lines.write.mode("append").option("maxRecordsPerFile", per_object).text(path)


def publish_kafka(rows: DataFrame, servers: str, topic: str, limit: int | None = None) -> None:
    """The same to a Kafka topic. Needs the connector package; not tested here."""
    if limit:
        rows = rows.limit(limit)
    rows.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("topic", topic).save()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_log(log: DataFrame, path: str) -> None:
    """Append envelopes to a log that is read as a stream."""
    log.select(*ENVELOPE.names).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).parquet(path)


@dataclass(frozen=True)
class LogStore:
    """A log for browsing: envelopes by append, partition and block of offsets, and a manifest.

    The manifest has a row per block of an append: its bounds, count and newest time. Totals,
    ends and times come from it; rows are read by block, so that files of other blocks are
    skipped. Its part of an append is one file written last, which makes the append visible
    as a whole.
    """

    path: str
    block: int = 100_000

    def append(self, log: DataFrame, name: str | None = None) -> str:
        """Append envelopes; offsets are given, or assigned before by ``number_by_id``.

        An append has a name, by default a digest of its messages. One that was broken off
        leaves nothing visible, and is replaced when it is tried again; one that is complete
        is not repeated. Messages whose partition and offset the log holds already are left
        out. Returns the name.
        """
        spark = log.sparkSession
        blocked = log.select(*ENVELOPE.names, F.floor(F.col("offset") / self.block).alias("block"))
        rows = saved(blocked, "append")
        name = name or _digest(rows)
        known = self.manifest(spark)
        if not known.where(F.col("append") == name).isEmpty():
            return name
        rows = self._unknown(rows, known)
        rows.repartition("partition", "block").sortWithinPartitions("partition", "block", "offset").write.mode(
            "overwrite"
        ).partitionBy("partition", "block").parquet(f"{self.path}/rows/append={name}")
        _spans(rows).select(*MANIFEST.names[:-1]).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/append={name}"
        )
        return name

    def _unknown(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows whose offsets no append holds. Only blocks whose bounds cross are compared."""
        spark = rows.sparkSession
        new = _spans(rows).select("partition", "block", F.col("first_offset").alias("_a"), F.col("last_offset").alias("_b"))
        crossing = known.join(new, ["partition", "block"]).where("first_offset <= _b AND last_offset >= _a")
        crossing = saved(crossing.select(*BLOCK), "crossing")
        if crossing.isEmpty():
            return rows
        held = self.stored(spark).join(crossing.where("block >= 0"), BLOCK).select("partition", "offset")
        return saved(rows.join(held, ["partition", "offset"], "left_anti"), "append")

    def stored(self, spark: SparkSession) -> DataFrame:
        """All that lies in the log's folders. The blocks of the manifest are those to be read."""
        return read_table(spark, f"{self.path}/rows", BLOCKED).select(*ENVELOPE.names, "append", "block")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The log's messages: those of complete appends."""
        return self.stored(spark).join(self.manifest(spark).select("append").distinct(), "append", "left_semi")

    def manifest(self, spark: SparkSession) -> DataFrame:
        """A row per block of each complete append."""
        return read_table(spark, f"{self.path}/manifest", MANIFEST)


def _digest(rows: DataFrame) -> str:
    """A name for a set of messages, whatever their order."""
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*ENVELOPE.names).cast("decimal(38,0)")).alias("sum")
    ).first()
    return f"{seen.n}-{int(seen['sum'] or 0) % (1 << 64):016x}"


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("partition", "block").agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.count(F.lit(1)).alias("n"),
        F.max("timestamp").alias("latest"),
    )


@dataclass(frozen=True)
class ConsumerGroup:
    """A reader of a stored log that remembers how far it got.

    A step is a range of offsets of each partition. It is written down before its messages
    are handed over, and marked as done afterwards: a step whose handler failed is handed
    over again, the same messages under the same number, and a handler that replaces what it
    wrote under that number sees each message once. Within a partition offsets must ascend
    from append to append. A group has one reader at a time.
    """

    store: LogStore
    name: str

    @property
    def _folder(self) -> str:
        return f"{self.store.path}/groups/{self.name}"

    def _ranges(self, spark: SparkSession, step: int) -> DataFrame:
        return read_table(spark, f"{self._folder}/ranges", RANGES).where(F.col("step") == step)

    def _last(self, spark: SparkSession, what: str) -> int | None:
        return read_table(spark, f"{self._folder}/{what}", RANGES).agg(F.max("step")).first()[0]

    def positions(self, spark: SparkSession) -> DataFrame:
        """Per partition of the log the first offset that was not handed over."""
        begins = self.store.manifest(spark).groupBy("partition").agg(F.min("first_offset").alias("_begin"))
        done = self._last(spark, "done")
        reached = self._ranges(spark, -1 if done is None else done).select("partition", "next_offset")
        return begins.join(reached, "partition", "left").select(
            "partition", F.coalesce("next_offset", "_begin").alias("_from")
        )

    def _plan(self, spark: SparkSession, limit: int | None) -> DataFrame:
        """Ranges of a new step. With a limit, partitions take turns until it is reached."""
        manifest = self.store.manifest(spark)
        starts = saved(self.positions(spark), "positions")
        if limit:
            blocks = holding_first(blocks_from(manifest, starts), limit)
            turns = last_n(seek(self.store.stored(spark), blocks).select("partition", "offset"), ["partition"], [F.col("offset")], limit)
            turn = F.row_number().over(Window.partitionBy("partition").orderBy("offset"))
            taken = turns.withColumn("_turn", turn).orderBy("_turn", "partition").limit(limit)
            ends = taken.groupBy("partition").agg((F.max("offset") + 1).alias("_to"))
        else:
            ends = manifest.groupBy("partition").agg((F.max("last_offset") + 1).alias("_to"))
        return starts.join(ends, "partition", "left").select(
            "partition", F.col("_from").alias("from_offset"), F.greatest("_from", "_to").alias("next_offset")
        )

    def messages(self, spark: SparkSession, step: int) -> DataFrame:
        """Messages of a planned step; only the blocks that hold them are read."""
        ranges = self._ranges(spark, step).where("next_offset > from_offset")
        ranges = ranges.select("partition", F.col("from_offset").alias("_from"), F.col("next_offset").alias("_to"))
        blocks = blocks_from(self.store.manifest(spark), ranges).where(F.col("first_offset") < F.col("_to"))
        return seek(self.store.stored(spark), blocks).select(*ENVELOPE.names)

    def take(self, spark: SparkSession, handle: Callable[[DataFrame, int], None], limit: int | None = None) -> int | None:
        """Hand over what is new, ``limit`` messages at most, and remember it.

        Returns the number of the step, or None if there was nothing. A step that was not
        done before comes first, with the limit it was planned under.
        """
        planned, done = self._last(spark, "ranges"), self._last(spark, "done")
        if planned is None or planned == done:
            plan = saved(self._plan(spark, limit), "ranges")
            if plan.where("next_offset > from_offset").isEmpty():
                return None
            planned = 0 if done is None else done + 1
            plan.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/ranges/step={planned}")
        handle(self.messages(spark, planned), planned)
        mark = self._ranges(spark, planned).select("partition")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/done/step={planned}")
        return planned


def stream_log(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The log as a stream; progress lives in the query's checkpoint.

    A first run over a long log goes through it in batches of this many files. Files are
    read whole: a bound on messages, as ``stream_kafka`` has it, does not apply here.
    """
    reader = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_kafka(
    spark: SparkSession, servers: str, topic: str, records_per_batch: int | None = None, **options: str
) -> DataFrame:
    """The same envelope from a Kafka topic, from the earliest offset.

    Needs the connector package of the cluster; not tested here.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if records_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", records_per_batch)
    return reader.load().select(
        "partition",
        "offset",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        decode_value(F.col("value")).alias("value"),
    )


def consume(
    messages: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> None:
    """Hand everything new to ``handle`` and remember how far it got.

    The first run starts at the beginning. Progress advances only after ``handle``
    returns, so a failed batch is handed over again under the same batch number.
    """
    query = (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that a stream's checkpoint got with its first start and keeps."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
