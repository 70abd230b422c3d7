"""Product codes of vectors, with exact nearest entries by intersected bit masks.

Each component becomes an integer; a vector is cut into equal parts, and each part position
has a codebook that a few rounds of means improve. To find a part's nearest entry, the
entries' coordinates are sorted per dimension, and a mask of 64 bits is kept for each prefix
of that order. An initial radius, the distance to the best of a few entries near in one
coordinate, cuts a range out of each dimension; the range's entries are the difference of
two prefix masks. The masks of all dimensions, ANDed, leave the entries within the radius in
every coordinate. The nearest is among them, so its distance is exact.

Rows whose vector is null or has a null or non-finite component go. All others must have one
length, a multiple of ``PARTS``, and components below 2^20 in size; another length is an
error. Repeated vec_ids are rows of their own; among equal ids the smaller vector comes first.
Rows without vec_id are coded too, after all others in the order of the first entries. With
fewer rows than entries the codebooks are smaller. An empty table gives no rows. Columns but
vec_id, embedding and label are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import saved

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component's unit is 1 / SCALE.
SCALE = 256
#: Vectors handled at once.
ROWS = 4096


class MaskedEntries:
    """A codebook of up to 64 entries, searched through sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = len(entries)
        bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
        self.order = [np.argsort(c, kind="stable") for c in entries.T]
        self.sorted = [c[o] for c, o in zip(entries.T, self.order, strict=True)]
        self.prefix = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[o])]) for o in self.order]

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A distance within which each row of x has an entry, squared: to the entries next in a coordinate."""
        best = None
        for j, (order, coordinates) in enumerate(zip(self.order, self.sorted, strict=True)):
            at = np.minimum(np.searchsorted(coordinates, x[:, j]), len(order) - 1)
            for place in (at, np.maximum(at - 1, 0)):
                d = ((x - self.entries[order[place]]) ** 2).sum(axis=1)
                best = d if best is None else np.minimum(best, d)
        return best

    def candidates(self, x: np.ndarray, squared: np.ndarray) -> np.ndarray:
        """Per row the mask of entries that are within the radius in every coordinate."""
        reach = np.sqrt(squared).astype(np.int64) + 1  # never less than the root
        mask = np.full(len(x), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            lo = np.searchsorted(coordinates, x[:, j] - reach, "left")
            hi = np.searchsorted(coordinates, x[:, j] + reach, "right")
            mask &= prefix[hi] & ~prefix[lo]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest entry; the first of equal ones."""
        mask = self.candidates(x, self.radius(x))
        best = np.full(len(x), np.iinfo(np.int64).max)
        code = np.zeros(len(x), dtype=np.int64)
        for k, entry in enumerate(self.entries):
            rows = np.flatnonzero(mask >> np.uint64(k) & np.uint64(1))
            d = ((x[rows] - entry) ** 2).sum(axis=1)
            nearer = d < best[rows]
            best[rows[nearer]] = d[nearer]
            code[rows[nearer]] = k
        return code, best


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and integer components of the rows that have a whole vector."""
    whole = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    units = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(whole).select("vec_id", "label", units.alias("units"))


def first_codebooks(kept: DataFrame, n_parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts of the vectors with the smallest ids: an array by part, entry and position."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "units").select("units").limit(entries).collect()  # entries rows
    if not rows:
        return np.zeros((n_parts, 0, 0), dtype=np.int64)
    width = len(rows[0].units)
    if not width or width % n_parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {n_parts} equal parts")
    if any(len(r.units) != width for r in rows):
        raise ValueError(f"vectors must all have {width} components")
    return np.array([r.units for r in rows], dtype=np.int64).reshape(len(rows), n_parts, -1).swapaxes(0, 1).copy()


def _batches(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows with their components as an array."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            lists = batch.column(column)
            if len(lists) and not (np.diff(lists.offsets.to_numpy()) == width).all():
                raise ValueError(f"vectors must all have {width} components")
            yield batch, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigned(x: np.ndarray, books: list[MaskedEntries]) -> tuple[np.ndarray, np.ndarray]:
    """Codes by row and part, and squared distances likewise."""
    cut = x.reshape(len(x), len(books), -1)
    found = [book.nearest(np.ascontiguousarray(cut[:, p])) for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def improved(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after a round: entries that have parts become their means, rounded down.

    Tasks send sums, as many as the codebooks have components, whatever the number of rows.
    """
    n_parts, n, size = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [MaskedEntries(b) for b in codebooks]
        counts = np.zeros(n_parts * n, dtype=np.int64)
        sums = np.zeros((n_parts * n, size), dtype=np.int64)
        for _, x in _batches(batches, 0, n_parts * size):
            codes, _ = _assigned(x, books)
            slot = (codes + np.arange(n_parts) * n).ravel()
            counts += np.bincount(slot, minlength=len(counts))
            np.add.at(sums, slot, x.reshape(-1, size))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, size), pa.int64()),
                pa.array(np.tile(np.arange(size), len(used)), pa.int64()),
                pa.array(np.repeat(counts[used], size), pa.int64()),
                pa.array(sums[used].ravel(), pa.int64()),
            ],
            names=["slot", "position", "n", "total"],
        )

    rows = kept.select("units").mapInArrow(run, "slot long, position long, n long, total long")
    added = rows.groupBy("slot", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = codebooks.reshape(n_parts * n, size).copy()
    for row in added.collect():  # a row per component of the codebooks
        out[row.slot, row.position] = row.total // row.n
    return out.reshape(codebooks.shape)


def coded(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and squared error of each vector."""
    n_parts, _, size = codebooks.shape
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [MaskedEntries(b) for b in codebooks]
        for batch, x in _batches(batches, 2, n_parts * size):
            codes, errors = _assigned(x, books)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * n_parts
            code = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(errors.sum(axis=1), pa.int64())],
                names=schema.names,
            )

    return kept.select("vec_id", "label", "units").mapInArrow(run, schema)


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per vector its code and error, the error summed over its label, and the codebooks' digest."""
    kept = kept_vectors(vectors)
    codebooks = first_codebooks(kept)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = improved(kept, codebooks)
    rows = saved(coded(kept, codebooks), "codes") if codebooks.size else kept.select(
        "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")
    )
    # A row per label: small or not, the planner sees its size.
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = saved(totals.withColumnRenamed("label", "_label"), "label-errors")
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256")
    )
