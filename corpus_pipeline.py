"""A corpus from raw documents to token ids, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from millrace.llm.common import saved, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated blocks of lines; a document of which nothing is left goes.

    ``n_chars`` follows the text where it has changed.
    """
    found = line_dedup.without_repeats(docs)
    found = found.where((F.col("n_lines_removed") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        changed = F.col("n_lines_removed") > 0
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(changed, n_chars).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest doc_id.

    Texts are similar from 0.8 on by their shingles of five words.
    """
    return ngram_join.one_of_each(docs, percent=80, n_words=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and digests of them and of what they decode to."""
    held = docs.select("doc_id", "lang", "source", "text")
    found = bpe.encode_and_decode(held, bpe.public_vocabulary)
    return found.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_sha256("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("n-gram join", near_copies),
    ("decontamination", benchmark),
    ("byte-pair encoding", tokens),
]

#: Alignment, components and merges are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents below sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
