"""Small helpers shared by the text operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.session import scratch_path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back.

    The copy cuts the lineage and outlives a lost executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names, compared as Spark compares names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    compute: Callable[[], Callable[..., list]],
) -> DataFrame:
    """df with new columns made from its input columns, a record batch at a time.

    ``compute()`` is called once per task and returns a function from the batch's input
    columns to the new columns. Old columns of the new columns' names give way.
    """
    kept = without(df, [f.name for f in fields]).columns
    given = df.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)],
        *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(inputs)],
    )
    schema = T.StructType([*given.schema.fields[: len(kept)], *fields])
    arrow = to_arrow_schema(schema)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compute()
        for batch in (part for whole in batches for part in parts(whole)):
            new = made(*batch.columns[n:])
            new = [
                a.cast(arrow.field(n + i).type) if isinstance(a, pa.Array) else pa.array(a, arrow.field(n + i).type)
                for i, a in enumerate(new)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=arrow.names)

    return given.mapInArrow(run, schema).toDF(*kept, *[f.name for f in fields])


#: Bytes of rows handled at once; a longer row is handled alone.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of limited size."""
    if batch.nbytes <= limit or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from parts(batch.slice(0, half), limit)
    yield from parts(batch.slice(half), limit)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


#: Odd multipliers of the word and sequence hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of many texts as 64-bit hashes in one array.

    ``hashes[starts[i]:starts[i + 1]]`` are the words of text i.
    """

    def __init__(self, hashes: np.ndarray, starts: np.ndarray):
        self.hashes, self.starts = hashes, starts


def letter_words(batch: list[bytes]) -> Words:
    """Words of ASCII letters, digits and all non-ASCII characters; A-Z in lower case."""
    return _words(batch, _LETTERS)


def spaced_words(batch: list[bytes]) -> Words:
    """Words between ASCII white space; A-Z in lower case."""
    return _words(batch, _NO_SPACE)


def _table(inside: Callable[[int], bool]) -> np.ndarray:
    lower = lambda b: b + 32 if 65 <= b <= 90 else b
    return np.array([lower(b) if inside(b) else 0 for b in range(256)], dtype=np.uint8)


_LETTERS = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
# A NUL byte is a word character; it is stored as 255, which UTF-8 never uses.
_NO_SPACE = _table(lambda b: b != 32 and not 9 <= b <= 13)
_NO_SPACE[0] = 255


def word_parts(batch: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter words of the texts; per word its hash, first eight bytes, last four, and length."""
    data, first, end, starts = _ranges(batch, _LETTERS)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = end - first
    hashes = _hashes(data, first, end)
    last = eights[np.maximum(end - 4, first)] & np.uint64(0xFFFFFFFF)
    return Words(hashes, starts), hashes, eights[first], last, lengths


def _words(batch: list[bytes], kinds: np.ndarray) -> Words:
    data, first, end, starts = _ranges(batch, kinds)
    return Words(_hashes(data, first, end), starts)


def _ranges(batch: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, where words begin and end, and the first word of each text."""
    joined = b"\n".join(batch) + b"\n"
    kept = kinds[np.frombuffer(joined, dtype=np.uint8)]
    inside = kept != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    first, end = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, batch), dtype=np.int64, count=len(batch)) + 1
    limits = np.concatenate([[0], np.cumsum(lengths)])
    return kept, first, end, np.searchsorted(first, limits)


def _hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range: eight bytes at a time, all ranges together."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = end - first
    h = mixed(left.astype(np.uint64) * _BASE)
    at = first.copy()
    live = np.arange(len(first))
    while len(live):
        n = np.minimum(left[live], 8)
        part = eights[at[live]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - n) * 8).astype(np.uint64))
        h[live] = mixed(h[live] * _BASE + part)
        at[live] += n
        left[live] -= n
        live = live[left[live] > 0]
    return h


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in sequence, none across texts, and where each text's begin."""
    h, s = words.hashes, words.starts
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(s), dtype=np.int64)
    total = len(h) - n + 1
    g = h[:total].copy()
    for k in range(1, n):
        g = mixed(g * _BASE + h[k : total + k])
    counts = np.diff(s)
    of = np.repeat(np.arange(len(counts)), counts)[:total]
    fits = np.arange(total) + n <= s[1:][of]
    made = np.maximum(counts - n + 1, 0)
    return g[fits], np.concatenate([[0], np.cumsum(made)])


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer text is a range of its own."""
    lo = size = 0
    for i, b in enumerate(batch):
        if i > lo and size + len(b) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(b)
    if lo < len(batch):
        yield lo, len(batch)


def held_out(of: int, which: int) -> Column:
    """Rows that no label is learned from: by a checksum of the id. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == which, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, kept_out: Column, most: int) -> DataFrame:
    """doc_id, text and label of about ``most`` labelled rows at most, chosen by a hash of the id."""
    usable = labels.where(~kept_out & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, most / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # Its size is bounded by ``most``, whatever the size of the table.
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def fitted(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], object]) -> object:
    """The model that fit(texts, labels) makes of a bounded sample, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, labels = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held += utf8(batch.column(1))
            labels += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], held[i]))
        model = fit([held[i] for i in order], np.array([labels[i] for i in order], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else fit([], np.zeros(0, dtype=np.int64))
