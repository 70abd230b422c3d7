"""Writes under a contract, and metrics of stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from ..schemas import BOUNDS, GOLD, SILVER, stored
from .feeds import latest
from .sizing import measured


class ContractError(ValueError):
    """Columns do not match the contract of the table."""


def enforce(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Cast to the contract's columns and types.

    A missing or extra column is refused here; a null in a required column or a
    value that does not cast fails the write itself, in the same pass.
    """
    missing = [f.name for f in contract if f.name not in df.columns]
    extra = [c for c in df.columns if c not in contract.names]
    if missing or extra:
        raise ContractError(f"missing columns {missing}, unexpected columns {extra}")
    return df.select(*[_checked(f).alias(f.name) for f in contract])


def _checked(field: T.StructField) -> Column:
    value = F.col(field.name).cast(field.dataType)
    if field.nullable:
        return value
    refuse = F.raise_error(F.lit(f"null in required column {field.name}"))
    return F.when(value.isNotNull(), value).otherwise(refuse.cast(field.dataType))


def append(df: DataFrame, path: str, contract: T.StructType) -> None:
    """Append rows to a table under its contract; a bad row fails the whole append."""
    enforce(df, contract).write.mode("append").parquet(path)


#: Writer of batches that no stream numbers.
DIRECT = "direct"


def batch_folder(path: str, batch_id: int, writer: str = DIRECT) -> str:
    return f"{path}/writer={writer}/batch_id={batch_id}"


def write_batch(
    df: DataFrame, path: str, contract: T.StructType, batch_id: int, writer: str = DIRECT, bounded: bool = True
) -> None:
    """Write one batch of a writer as its own partition; writing it again replaces it.

    Batch numbers are the writer's own: batches of different writers never meet. A
    replacement of no rows leaves none of the old ones. The times the batch spans are
    stored last, beside the table, if it has a time column and is ``bounded``.
    """
    rows = enforce(df, contract).withColumn("ingested_at", F.current_timestamp())
    time = _time_of(contract) if bounded else None
    if not time:
        rows.write.mode("overwrite").parquet(batch_folder(path, batch_id, writer))
        return
    seen = Observation()
    watched = rows.observe(seen, F.min(time).alias("low"), F.max(time).alias("high"), F.count(F.lit(1)).alias("n"))
    watched.write.mode("overwrite").parquet(batch_folder(path, batch_id, writer))
    spans = T.StructType(BOUNDS.fields[:3])
    row = df.sparkSession.createDataFrame([tuple(seen.get[k] for k in spans.names)], spans)
    row.coalesce(1).write.mode("overwrite").parquet(batch_folder(_bounds(path), batch_id, writer))


def _bounds(path: str) -> str:
    return path.rstrip("/") + ".bounds"


def _time_of(contract: T.StructType) -> str | None:
    return next((c for c in ("timestamp", "window_start") if c in contract.names), None)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; one that nothing was written to yet reads as empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Columns that settle the order of equal times.
_TIES = {tuple(SILVER.names): ["event_id"], tuple(GOLD.names): ["window_end", "writer", "batch_id"]}


def scan_latest(
    spark: SparkSession, path: str, contract: T.StructType, limit: int | None = 500
) -> DataFrame:
    """Rows of a stored table, newest first; equal times in the order of the contract's key.

    With a limit, only batches are read that can hold one of the rows asked for.
    """
    rows = read_table(spark, path, stored(contract))
    if limit and (time := _time_of(contract)):
        rows = _newest(rows, read_table(spark, _bounds(path), BOUNDS), time, limit)
    return latest(rows, limit, _TIES.get(tuple(contract.names), contract.names))


def _newest(rows: DataFrame, bounds: DataFrame, time: str, limit: int) -> DataFrame:
    """Rows not older than a time from which on there are surely ``limit`` of them.

    Batches are taken by their earliest row, latest first, until they hold enough: at most
    ``limit`` batches, as each has a row. Nothing before the last one's earliest row can be
    among the newest, so batches that end before it are not opened. This looks at the bounds
    when it is called; a batch without bounds is one whose write has not ended.
    """
    newest = [F.col("low").desc(), "writer", "batch_id"]
    few = bounds.where("n > 0").orderBy(*newest).limit(limit)
    before = Window.orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)
    taken = few.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    since = taken.where(F.col("_before") < limit).agg(F.min("low")).first()[0]
    if since is None:
        return rows
    late = F.lit(str(since)).cast("timestamp_ntz")
    batches = measured(bounds.where(F.col("high") >= late)).where(F.col("high") >= late)
    return rows.where(F.col(time) >= late).join(batches.select("writer", "batch_id"), ["writer", "batch_id"])


def table_metrics(table: DataFrame) -> DataFrame:
    """Rows, snapshots, current snapshot and last change of a table.

    Aggregated per batch first: the distinct count then runs over batches, not rows. The
    current snapshot is the last batch of the writer that wrote last.
    """
    writer = F.col("writer") if "writer" in table.columns else F.lit(DIRECT)
    return (
        table.groupBy(writer.alias("writer"), "batch_id")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("ingested_at").alias("_at"))
        .groupBy("writer")
        .agg(
            F.sum("_rows").alias("_rows"),
            F.count("batch_id").alias("_batches"),
            F.max("batch_id").alias("_last"),
            F.max("_at").alias("_at"),
        )
        .agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("record_count"),
            F.coalesce(F.sum("_batches"), F.lit(0)).cast("bigint").alias("snapshot_count"),
            F.max_by("_last", F.struct("_at", "writer")).alias("current_snapshot_id"),
            F.max("_at").alias("last_updated"),
        )
    )
