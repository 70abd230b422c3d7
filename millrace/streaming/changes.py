"""Change detection over samples that come batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.feeds import drop_unchanged
from ..operators.ordering import time_bucket
from ..operators.tables import enforce, read_table
from ..session import saved
from ..sources.logs import consume
from .keyed import KeyedTable

_BATCH = T.StructField("batch_id", T.LongType())


@dataclass(frozen=True)
class OnlineChanges:
    """Samples whose values differ from those of the sample before, as ``feeds.drop_unchanged``
    finds them, however the samples are cut into batches.

    The last sample of each key is the state, in a table by key. A sample that is not newer
    than its key's last one in an earlier batch is late: it is stored apart and changes
    nothing. ``order`` is total within a key, and its first column a time. A batch that is
    repeated starts from the state before it and replaces its own rows.
    """

    root: str
    schema: T.StructType
    key: list[str]
    order: list[str]
    values: list[str]
    seconds: int = 86_400
    buckets: int = 64

    @property
    def state(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/state", self.schema, self.key, self.order, self.buckets)

    def _stored(self, spark: SparkSession, what: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, _BATCH])
        return read_table(spark, f"{self.root}/{what}", schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, "changes").select(*self.schema.names)

    def read_late(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, "late").select(*self.schema.names)

    def process(self, samples: DataFrame, batch_id: int) -> None:
        samples = saved(enforce(samples, self.schema), "samples")
        last = saved(self.state.read_for(samples, batch_id), "last")
        before = F.struct(*[F.col(f"_last.{c}") for c in self.order])
        same = F.lit(True)
        for c in self.key:
            same = same & samples[c].eqNullSafe(F.col(f"_last.{c}"))
        held = last.select(F.struct("*").alias("_last"))
        placed = samples.join(held, same, "left")
        late = F.col("_last").isNotNull() & (F.struct(*[samples[c] for c in self.order]) <= before)
        placed = saved(placed.select(*[samples[c] for c in self.schema.names], late.alias("_late")), "placed")
        fresh = placed.where("NOT _late").drop("_late")
        both = fresh.withColumn("_new", F.lit(True)).unionByName(last.withColumn("_new", F.lit(False)))
        changed = drop_unchanged(both, self.key, self.order, self.values, time_bucket(self.order[0], self.seconds))
        for what, rows in (("changes", changed.where("_new").drop("_new")), ("late", placed.where("_late").drop("_late"))):
            rows.write.mode("overwrite").parquet(f"{self.root}/{what}/batch_id={batch_id}")
        self.state.upsert(fresh, batch_id)


def run_changes(samples: DataFrame, changes: OnlineChanges, checkpoint: str) -> None:
    """Take in all samples of a stream that arrived since the last run."""
    consume(samples, checkpoint, changes.process)
