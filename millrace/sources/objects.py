"""Object stores: inventories, whole-object text and CSV objects."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import saved


_LISTED = "path string, length bigint, modificationTime timestamp"
_ENTRIES = pa.schema(
    [
        ("path", pa.string()),
        ("length", pa.int64()),
        ("modificationTime", pa.timestamp("us", "UTC")),
        ("folder", pa.bool_()),
    ]
)
#: Names of a folder that one task looks at, and entries in a batch.
NAMES, SLICE = 10_000, 5_000


def _entries(folder: str, share: int, shares: int) -> Iterator[tuple]:
    """Entries of a folder, itself only, whose names fall into one of so many shares.

    On a mounted file system names come one by one, and only those of the share are looked
    up; other stores answer for the folder as a whole.
    """
    store, top = FileSystem.from_uri(folder)
    root = folder.rstrip("/").removesuffix(top.rstrip("/"))
    own = lambda name: zlib.crc32(name.encode(errors="surrogateescape")) % shares == share
    if isinstance(store, LocalFileSystem):
        with os.scandir(top) as found:
            for e in found:
                if own(e.name):
                    try:
                        seen, is_folder = e.stat(), e.is_dir()
                    except FileNotFoundError:  # deleted meanwhile, or a link to nothing
                        continue
                    yield root + e.path, None if is_folder else seen.st_size, seen.st_mtime_ns // 1000, is_folder
        return
    for e in store.get_file_info(FileSelector(top)):
        if own(e.base_name):
            yield root + e.path, e.size, None if e.mtime_ns is None else e.mtime_ns // 1000, e.type == FileType.Directory


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of shares of folders, in batches of limited size."""
    for batch in batches:
        for unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entries = _entries(*unit)
            while rows := list(itertools.islice(entries, SLICE)):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRIES, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_ENTRIES)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many names each folder has, as far as that is cheap to tell: else none."""
    for batch in batches:
        counts = []
        for folder in batch.column(0).to_pylist():
            store, top = FileSystem.from_uri(folder)
            n = 0
            if isinstance(store, LocalFileSystem):
                with os.scandir(top) as found:
                    n = sum(1 for _ in found)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["path", "names"])


def list_objects(spark: SparkSession, folder: str, names: int = NAMES) -> DataFrame:
    """Path, size and time of every object below a folder; contents are not read.

    Folders are listed level by level. A folder of very many names is dealt out: each task
    takes those whose hash falls to it, ``names`` of them on average, and hands them on in
    slices. Spark's own file sources would pass over empty objects and names that begin with
    ``_`` or ``.``; these are listed too.
    """
    level = spark.createDataFrame([(re.sub("^file:/+", "file:///", folder),)], "path string")
    width = spark.sparkContext.defaultParallelism
    found = None
    while True:
        sized = level.repartition(width).mapInArrow(_sizes, "path string, names bigint")
        shares = F.greatest(F.ceil(F.col("names") / names), F.lit(1)).cast("bigint")
        units = sized.select("path", shares.alias("shares"))
        units = saved(units.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "shares"), "units")
        spread = units.repartition(max(width, min(units.count(), 100 * width)), "path", "share")
        entries = saved(spread.mapInArrow(_listing, f"{_LISTED}, folder boolean"), "listing")
        objects = entries.where("NOT folder").drop("folder")
        found = objects if found is None else found.unionAll(objects)
        level = entries.where("folder").select("path")
        if level.isEmpty():
            return found


def read_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Whole objects as text, one row each. An object must fit in one row."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


_CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV objects with a header; quotes are doubled, as other readers expect."""
    df.write.options(**_CSV).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote: text keeps its line breaks, quotes and outer spaces.

    A bare empty field is null, a quoted one an empty text: the parser tells them apart
    only if null has a name of its own, for which a noncharacter stands.
    """
    options = {**_CSV, "multiLine": True, "nullValue": "\ufdd0"}
    return spark.read.schema(schema).options(**options).csv(folder)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def whole_objects(parts: DataFrame) -> DataFrame:
    """Objects that tasks wrote in parts: a folder of parts is one object, of all their bytes."""
    return (
        parts.groupBy(folder_of(F.col("path")).alias("path"))
        .agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    )


def bucket_metrics(inventory: DataFrame) -> DataFrame:
    """Object count and bytes per folder."""
    return (
        inventory.groupBy(folder_of(F.col("path")).alias("folder"))
        .agg(F.count(F.lit(1)).alias("object_count"), F.sum("length").alias("total_bytes"))
    )


def store_totals(inventory: DataFrame) -> DataFrame:
    """Object count and bytes overall; zero for an empty store."""
    return inventory.agg(
        F.count(F.lit(1)).alias("object_count"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
