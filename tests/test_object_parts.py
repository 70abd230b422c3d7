import json
import random
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F

from millrace.plans import queries
from millrace.plans.queries import QUERIES
from millrace.session import scratch_folder
from millrace.sources import objects


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in values}
    for k, v in values.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def stored_documents(spark, folder, files):
    """So many files of documents, four in five of one language; the bytes of each language's lines."""
    rng = random.Random(files)
    rows, sizes = [], {}
    for i in range(150 * files):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=800)) if i % 50 else None
        lang = "de" if i % 10 == 3 else "fr" if i % 10 == 7 else "en"
        rows.append((i, text, lang, 800))
        fields = {"doc_id": i, "text": text, "n_chars": 800}
        line = json.dumps({k: v for k, v in fields.items() if v is not None}, separators=(",", ":"))
        sizes[lang] = sizes.get(lang, 0) + len(line) + 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    docs.repartition(files).write.parquet(f"{folder}/documents.parquet")
    return sizes


def published(spark, query, folder):
    """Rows of a query, and the sizes of the parts that it published."""
    store = Path(scratch_folder(spark).removeprefix("file://"))
    before = set(store.glob("documents-*"))
    rows = QUERIES[query](spark, folder).collect()
    (new,) = set(store.glob("documents-*")) - before
    return rows, {p: p.stat().st_size for p in new.glob("lang=*/part-*")}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_frequent_language_is_published_by_many_tasks(spark, tmp_path, adaptive):
    largest = {}
    for files in (6, 18):
        folder = str(tmp_path / f"of-{files}")
        sizes = stored_documents(spark, folder, files)
        conf = {"adaptive.advisoryPartitionSizeInBytes": "96k", "adaptive.enabled": adaptive, "files.openCostInBytes": "1m", "files.maxPartitionBytes": "1m"}
        with settings(spark, **conf):
            rows, parts = published(spark, "object_inventory", folder)
            (total,), again = published(spark, "store_totals", folder)
        assert {r.lang: r.length for r in rows} == sizes and len(rows) == 3
        assert tuple(total) == (3, sum(sizes.values()))
        assert sum(parts.values()) == sum(again.values()) == sum(sizes.values())
        largest[files] = max([*parts.values(), *again.values()])
        assert largest[files] < sizes["en"] / 2
    assert largest[18] < 1.5 * largest[6]  # of three times the input


def test_a_language_in_one_row_group_is_published_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "DEALT", 64, raising=False)
    largest = {}
    for files in (6, 18):
        sizes = stored_documents(spark, str(tmp_path / f"of-{files}"), files)
        folder = str(tmp_path / f"one-of-{files}")
        docs = spark.read.parquet(str(tmp_path / f"of-{files}/documents.parquet"))
        docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        (file,) = Path(folder).glob("documents.parquet/part-*")
        assert ParquetFile(file).metadata.num_row_groups == 1
        conf = {"shuffle.partitions": "64", "adaptive.advisoryPartitionSizeInBytes": "96k", "adaptive.coalescePartitions.minPartitionSize": "64k"}
        with settings(spark, **conf):
            rows, parts = published(spark, "object_inventory", folder)
            (total,), again = published(spark, "store_totals", folder)
        assert {r.lang: r.length for r in rows} == sizes and len(rows) == 3
        assert tuple(total) == (3, sum(sizes.values()))
        assert sum(parts.values()) == sum(again.values()) == sum(sizes.values())
        largest[files] = max([*parts.values(), *again.values()])
        assert largest[files] < sizes["en"] / 2
    assert largest[18] < 2 * largest[6]  # of three times the input


def test_a_folder_of_parts_is_one_object(spark):
    times = F.timestamp_seconds(F.col("t")).alias("modificationTime")
    listed = [("s/lang=en/part-0", 2**40, 1), ("s/lang=en/part-1", 2**40, 3), ("s/lang=de/part-0", 0, 2)]
    parts = spark.createDataFrame(listed, "path string, length bigint, t bigint").select("path", "length", times)
    found = objects.whole_objects(parts)
    assert found.schema == parts.schema
    got = found.withColumn("t", F.unix_seconds("modificationTime")).select("path", "length", "t")
    assert {tuple(r) for r in got.collect()} == {("s/lang=en", 2**41, 3), ("s/lang=de", 0, 2)}
    assert objects.whole_objects(parts.where("1 = 0")).count() == 0
