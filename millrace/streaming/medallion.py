"""The incremental job: log to cleansed table, quarantine and KPI table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.kpis import merged_kpis, partial_kpis
from ..operators.quality import check_messages, quarantine_rows, valid_rows
from ..operators.tables import batch_folder, read_table, write_batch
from ..schemas import COUNTERS, GOLD, GOLD_PARTIAL, QUARANTINE, SILVER, stored
from ..sources.logs import checkpoint_id, consume


@dataclass
class Medallion:
    """Folders of the tables.

    Any number of checkpoints may write to them: a batch is known by its checkpoint's
    identity and its number. ``first_batch`` shifts the numbers where they should differ too.
    """

    root: str
    first_batch: int = 0

    @property
    def silver(self) -> str:
        return f"{self.root}/silver"

    @property
    def gold(self) -> str:
        return f"{self.root}/gold"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def counters(self) -> str:
        return f"{self.root}/counters"

    @property
    def finished(self) -> str:
        return f"{self.root}/finished"

    def read_silver(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.silver, stored(SILVER))

    def read_quarantine(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.quarantine, stored(QUARANTINE))

    def _partials(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.gold, stored(GOLD_PARTIAL))

    def read_gold(self, spark: SparkSession) -> DataFrame:
        """One KPI row per run, whatever number of batches it took; ``batch_id`` is its first."""
        when = F.max("ingested_at").alias("ingested_at")
        runs = merged_kpis(self._partials(spark), ["writer", "run"], when).withColumnRenamed("run", "batch_id")
        return runs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored(GOLD)])

    def read_hourly(self, spark: SparkSession) -> DataFrame:
        """KPIs per hour of all runs; late readings count in the hour they belong to."""
        hours = merged_kpis(self._partials(spark), ["hour_start"])
        return hours.select("hour_start", *GOLD.names)

    def batch_counters(self, spark: SparkSession) -> DataFrame:
        """What each batch did. Stored as its last table, so a batch is there as a whole."""
        return read_table(spark, self.counters, stored(COUNTERS))

    def run_counters(self, spark: SparkSession) -> DataFrame:
        """What each run did, over all its batches, also those before a failure."""
        return (
            self.batch_counters(spark)
            .groupBy("writer", "run")
            .agg(
                F.sum("ingested").alias("ingested"),
                F.sum("processed").alias("processed"),
                F.sum("invalidated").alias("invalidated"),
                F.max((F.col("processed") > 0).cast("bigint")).alias("kpis"),
                F.count(F.lit(1)).alias("batches"),
            )
        )


@dataclass
class RunCounters:
    """What a run did; ``batches`` are the numbers of its batches."""

    ingested: int = 0
    processed: int = 0
    invalidated: int = 0
    kpis: int = 0
    batches: list[int] = field(default_factory=list)


def process_batch(messages: DataFrame, number: int, tables: Medallion, writer: str, run: int) -> None:
    """Validate one batch of a writer and write its partitions of all tables.

    Each write replaces the partition of this writer and batch, so a replay after a failure
    leaves no duplicates, and batches of other writers stay. Counters are observed during
    the first write and stored by the last. KPIs are stored as hourly sums, which the readers
    merge: how a run was cut into batches, and how late a reading came, makes no difference.
    """
    spark = messages.sparkSession
    checked = check_messages(messages)
    # raw text is kept only where it goes to quarantine: less to hold between the writes
    raw = F.when(F.size("reasons") > 0, F.col("value"))
    checked = checked.withColumn("value", raw).drop("timestamp")
    checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = Observation()
        watched = checked.observe(
            seen,
            F.count(F.lit(1)).alias("ingested"),
            F.count_if(F.size("reasons") == 0).alias("processed"),
        )
        valid = valid_rows(watched)
        silver = valid.withColumnRenamed("event_time", "timestamp").select(*SILVER.names)
        write_batch(silver, tables.silver, SILVER, number, writer)
        write_batch(quarantine_rows(checked), tables.quarantine, QUARANTINE, number, writer)
        # KPIs come from the doubles, before the table narrows them to float
        partials = partial_kpis(valid_rows(checked)).withColumn("run", F.lit(run).cast("bigint"))
        write_batch(partials, tables.gold, GOLD_PARTIAL, number, writer, bounded=False)
        ingested, processed = seen.get["ingested"], seen.get["processed"]
        row = (run, ingested, processed, ingested - processed)
        counts = spark.createDataFrame([row], COUNTERS).coalesce(1)
        write_batch(counts, tables.counters, COUNTERS, number, writer)
    finally:
        checked.unpersist()


def _open_run(spark: SparkSession, tables: Medallion, writer: str) -> int | None:
    """The writer's last run, if it has not finished."""
    own = tables.batch_counters(spark).where(F.col("writer") == writer)
    last = own.agg(F.max_by("run", "batch_id")).first()[0]
    if last is None:
        return None
    ended = read_table(spark, tables.finished, stored(COUNTERS))
    ended = ended.where((F.col("writer") == writer) & (F.col("batch_id") == last))
    return last if ended.isEmpty() else None


def _counted(spark: SparkSession, tables: Medallion, writer: str, run: int) -> RunCounters:
    own = tables.batch_counters(spark).where((F.col("writer") == writer) & (F.col("run") == run))
    rows = own.select("ingested", "processed", "invalidated", "batch_id").collect()  # a row per batch
    ingested, processed, invalidated = (sum(r[i] for r in rows) for i in range(3))
    return RunCounters(ingested, processed, invalidated, int(processed > 0), sorted(r.batch_id for r in rows))


def run_available(messages: DataFrame, tables: Medallion, checkpoint: str) -> RunCounters:
    """Process everything that arrived since the last run, then stop.

    A run is named by its writer and its first batch. One that failed is taken up again by
    the next call, which then counts all its batches.
    """
    spark = messages.sparkSession
    known: dict[str, str | int | None] = {}

    def take_up() -> None:
        if not known:
            writer = checkpoint_id(spark, checkpoint)
            known.update(writer=writer, run=_open_run(spark, tables, writer))

    def handle(batch: DataFrame, batch_id: int) -> None:
        take_up()
        number = tables.first_batch + batch_id
        if known["run"] is None:
            known["run"] = number
        process_batch(batch, number, tables, known["writer"], known["run"])

    consume(messages, checkpoint, handle)
    take_up()
    writer, run = known["writer"], known["run"]
    if run is None:
        return RunCounters()
    counters = _counted(spark, tables, writer, run)
    row = (run, counters.ingested, counters.processed, counters.invalidated)
    spark.createDataFrame([row], COUNTERS).coalesce(1).write.mode("overwrite").parquet(
        batch_folder(tables.finished, run, writer)
    )
    return counters
