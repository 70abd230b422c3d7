"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """Session for tests and benchmarks on one machine; ``shared`` is its checkpoint folder."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name for an intermediate table that every executor can reach."""
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back.

    The copy cuts the lineage, outlives a lost executor and tells the planner its size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.

    Results built on them can no longer be read afterwards.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where that is unset, below the warehouse folder; on a cluster only if that names a
    store, as a folder of one machine would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and not re.match(r"(?!file:)[a-z0-9]+://", base):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = re.sub("^file:/+", "file:///", base.rstrip("/"))
    return f"{base}/millrace/{spark.sparkContext.applicationId}"
