"""Product codes against plain comparison of every part with every entry, and odd input."""

import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm.queries import QUERIES
from millrace.llm.vector_codes import ENTRIES, PARTS, MaskedEntries, compressed


def plain(rows, rounds=2):
    """(vec_id, embedding, label) rows to (vec_id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // PARTS
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(PARTS)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:ENTRIES]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(PARTS)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((distance(c, e), k) for k, e in enumerate(books[p])) for p, c in enumerate(cut(v))]
    for _ in range(rounds):
        found = [assign(v) for _, v, _ in kept]
        for p in range(PARTS):
            for k in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books_p = [sum(c) // len(own) for c in zip(*own, strict=True)]
                    books[p] = books[p][:k] + [books_p] + books[p][k + 1 :]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    final = [(i, assign(v), label) for i, v, label in kept]
    totals = {}
    for _, f, label in final:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in f)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), totals[label], digest) for i, f, label in final]


@pytest.mark.parametrize("n", [1, 2, 30, 64])
@pytest.mark.parametrize("spread", [1, 5, 10_000])
def test_nearest_is_exact(n, spread):
    rng = np.random.default_rng(n + spread)
    entries = rng.integers(-spread, spread + 1, (n, 4))
    entries[n // 2] = entries[0]
    x = rng.integers(-2 * spread, 2 * spread + 1, (500, 4))
    x[:n] = entries
    code, best = MaskedEntries(entries).nearest(x)
    d = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (code == d.argmin(axis=1)).all()


def test_masks_hold_all_within_the_radius_and_few_others():
    rng = np.random.default_rng(0)
    entries, x = rng.integers(-500, 500, (64, 4)), rng.integers(-500, 500, (200, 4))
    book = MaskedEntries(entries)
    squared = book.radius(x)
    mask = book.candidates(x, squared)
    held = (mask[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    d = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert held[d <= squared[:, None]].all()
    assert held.sum(axis=1).mean() < 32


SCHEMA = "vec_id long, embedding array<float>, label int"


def make(n, seed=1, dims=32):
    rng = random.Random(seed)
    return [(rng.randrange(10**6), [round(rng.uniform(-2, 2), 2) for _ in range(dims)], rng.choice([0, 1, 1, 1, None])) for _ in range(n)]


def as_float(rows):
    """Components as the single-precision numbers that the table stores."""
    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def same(spark, rows):
    got = compressed(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(as_float(rows)), key=str)


def test_plain_version(spark):
    same(spark, make(300))


def test_fewer_rows_than_entries_repeats_and_ties(spark):
    rows = make(9)
    same(spark, rows + rows[:3] + [(rows[0][0], rows[1][1], 5), (None, rows[2][1], None)])
    same(spark, [(i, [0.5] * 16, 1) for i in range(80)])


def test_broken_vectors_go(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [nan] * 32, 1), (3, [inf, *[0.0] * 31], 1), (4, [None, *[0.0] * 31], 1), (5, [-inf] * 32, None)]
    same(spark, make(70) + bad)
    assert compressed(spark.createDataFrame(bad, SCHEMA)).collect() == []
    assert compressed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_lengths_are_an_error(spark):
    for rows in ([(1, [1.0] * 10, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)]):
        with pytest.raises(Exception, match="components"):
            compressed(spark.createDataFrame(rows, SCHEMA)).collect()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(*r, "x", 7) for r in make(20)], SCHEMA + ", CODE string, units int")
    got = compressed(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(as_float(make(20))), key=str)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, QUERIES["op11_vector_codes"](spark, sf_dir).collect())) == sorted(plain(rows))
