"""Tables that hold one row per key, updated batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.feeds import merge_feed, newest_per_key
from ..operators.sizing import measured
from ..operators.tables import enforce, read_table
from ..session import saved

VERSIONS = T.StructType([T.StructField("version", T.LongType()), T.StructField("bucket", T.LongType())])


class VersionError(ValueError):
    """A batch older than what the table has taken in."""


@dataclass(frozen=True)
class KeyedTable:
    """The newest row of each key, by ``order``; equal order is settled by the other columns.

    Rows lie in buckets by a hash of the key. A batch rewrites the buckets that it touches
    and leaves the others; what it wrote becomes visible by one small file, written last. The
    buckets of each batch stay until ``expire``, so the table can be read as it was before a
    batch, and a batch that is repeated starts from there. A null key is a key. Batches come
    from one writer, in ascending numbers. ``buckets`` is fixed for the life of a table.
    """

    path: str
    schema: T.StructType
    key: list[str]
    order: list[str]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))

    def _versions(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, f"{self.path}/versions", VERSIONS)

    def _current(self, spark: SparkSession, before: int | None) -> DataFrame:
        """The batch that wrote each bucket last."""
        versions = self._versions(spark)
        if before is not None:
            versions = versions.where(F.col("version") < before)
        return versions.groupBy("bucket").agg(F.max("version").alias("version"))

    def _rows(self, spark: SparkSession, buckets: DataFrame) -> DataFrame:
        """Rows of some buckets as batches wrote them; files of others are not opened."""
        rows = read_table(spark, f"{self.path}/rows", T.StructType([*self.schema.fields, *VERSIONS.fields]))
        few = measured(buckets.select("version", "bucket")).where("bucket >= 0")
        return rows.join(few, ["version", "bucket"]).select(*self.schema.names)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All rows, as they are or as they were before a batch."""
        return self._rows(spark, self._current(spark, before))

    def read_for(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of the buckets that the keys of ``rows`` fall into; keys beside these may be among them."""
        touched = rows.select(self._bucket().alias("bucket")).distinct()
        return self._rows(rows.sparkSession, self._current(rows.sparkSession, before).join(touched, "bucket"))

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Take in a batch. Repeating it gives the same table, also after it broke off."""
        spark = rows.sparkSession
        last = self._versions(spark).agg(F.max("version")).first()[0]
        if last is not None and last > version:
            raise VersionError(f"batch {version} comes after batch {last}")
        new = saved(newest_per_key(enforce(rows, self.schema), self.key, self.order), "upsert")
        old = self.read_for(new, version)
        merged = newest_per_key(old.unionByName(new), self.key, self.order).withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/rows/version={version}"
        )
        new.select(self._bucket().alias("bucket")).distinct().coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/versions/version={version}"
        )

    def expire(self, spark: SparkSession, before: int) -> None:
        """Delete buckets that later batches replaced before batch ``before``."""
        current = self._current(spark, before).withColumnRenamed("version", "_kept")
        old = self._versions(spark).join(current, "bucket").where("version < _kept")
        path = spark._jvm.org.apache.hadoop.fs.Path
        for row in old.select("version", "bucket").toLocalIterator():  # folder names, one at a time
            folder = path(f"{self.path}/rows/version={row.version}/bucket={row.bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class FeedHead:
    """The newest ``n`` rows of a feed, kept beside it.

    A page is merged with them as ``feeds.merge_feed`` does it. Rows older than the last one
    of a full head cannot enter, which the scan of the page is told, so a page costs its own
    new rows and not the history. Every page writes its head as a version: a page that is
    repeated starts from the head before it.
    """

    path: str
    schema: T.StructType
    key: str | None
    time: str
    n: int

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        versions = read_table(spark, self.path, T.StructType([*self.schema.fields, VERSIONS.fields[0]]))
        if before is not None:
            versions = versions.where(F.col("version") < before)
        last = versions.agg(F.max("version")).first()[0]
        rows = versions.where(F.col("version") == (-1 if last is None else last))
        return rows.select(*self.schema.names)

    def add(self, page: DataFrame, version: int) -> None:
        head = self.read(page.sparkSession, version)
        held, timed, oldest = head.agg(F.count(F.lit(1)), F.count(self.time), F.min(self.time)).first()
        if held >= self.n and timed == held:
            page = page.where(F.col(self.time) >= F.lit(str(oldest)).cast(self.schema[self.time].dataType))
        merged = merge_feed(head, enforce(page, self.schema), self.key, self.time, self.n)
        merged.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
