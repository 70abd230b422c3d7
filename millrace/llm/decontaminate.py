"""Benchmark passages in documents, by suffix arrays over shards of the documents.

Each task sorts the word suffixes of a shard of its documents and binary-searches every
suffix of the benchmark items in it. The neighbours of the place found give the longest
verbatim match; the range of suffixes that begin with a window gives all its places. Places
of an item's windows are marked once for each different window, and those that overlap make
one match, so what a document holds of an item takes no more memory than its words.

Words are runs of ASCII letters, digits and non-ASCII characters; A-Z count as lower case.
A window is ``window`` words in sequence, or a whole shorter item. Null and empty texts
have no words and match nothing. Items of equal id count once; the places of an item
without id count, but it is not listed. Repeated documents get equal results. An empty
benchmark leaves every document clean. Benchmarks of any size are written in blocks to the
shared folder; tasks open them one after another for each shard, so that neither the driver
nor a task holds more than one.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Words, add_columns, letter_words, slices, utf8, without
from millrace.session import scratch_path

WINDOW = 10
#: Bytes of benchmark text sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Bytes of documents in one suffix array.
SHARD_BYTES = 4 << 20

#: Stands between documents; no word has this hash but by a chance of 1 in 2^64.
_BETWEEN = np.uint64(0)


class SuffixArray:
    """Suffixes of a word sequence, ordered by their first depth words."""

    def __init__(self, words: np.ndarray, depth: int):
        self.words = words
        self.order = self._sorted(words, depth)

    @staticmethod
    def _sorted(words: np.ndarray, depth: int) -> np.ndarray:
        """Prefix doubling: in each round only suffixes that still tie are sorted anew."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        at = words[order]
        first = np.ones(n, dtype=bool)
        first[1:] = at[1:] != at[:-1]
        settled = at == _BETWEEN
        rank = np.zeros(n + 1, dtype=np.int64)
        rank[n] = -1
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = group
        k = 1
        while k < depth:
            alone = first & np.append(first[1:], True)
            tied = np.flatnonzero(~(alone | settled))
            if not len(tied):
                break
            second = rank[np.minimum(order[tied] + k, n)]
            own = group[tied]
            again = np.lexsort((second, own))
            order[tied] = order[tied[again]]
            second = second[again]
            starts = np.ones(len(tied), dtype=bool)
            starts[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
            first[tied] = starts
            group[tied] = np.maximum.accumulate(np.where(starts, tied, 0))
            rank[order[tied]] = group[tied]
            k *= 2
        return order

    def common(self, at: np.ndarray, test: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words that the suffix at each place shares with its test suffix, length at most."""
        n = len(self.words)
        shared = np.zeros(len(q), dtype=np.int64)
        live = np.flatnonzero((length > 0) & (at < n))
        while len(live):
            equal = self.words[at[live] + shared[live]] == test[q[live] + shared[live]]
            live = live[equal]
            shared[live] += 1
            live = live[(shared[live] < length[live]) & (at[live] + shared[live] < n)]
        return shared

    def place(self, test: np.ndarray, q: np.ndarray, length: np.ndarray, after: bool = False) -> np.ndarray:
        """Binary search: how many suffixes stand before each test sequence; with after,
        those that begin with it are among them."""
        n = len(self.order)
        lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), n, dtype=np.int64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            at = self.order[mid]
            shared = self.common(at, test, q[live], length[live])
            whole = shared == length[live]
            ended = at + shared >= n
            i, j = np.minimum(at + shared, n - 1), np.minimum(q[live] + shared, len(test) - 1)
            less = np.where(whole, after, ended | (self.words[i] < test[j]))
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def longest(self, test: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Length of the longest verbatim match of each test suffix."""
        place, best = self.place(test, q, length), np.zeros(len(q), dtype=np.int64)
        for side in (place - 1, place):
            there = np.flatnonzero((side >= 0) & (side < len(self.order)))
            best[there] = np.maximum(best[there], self.common(self.order[side[there]], test, q[there], length[there]))
        return best


class TestItems:
    """Suffixes of benchmark items that can hold a window."""

    __test__ = False

    def __init__(self, rows: list[tuple[object, str | None]], window: int):
        kept = [(i, t) for i, t in rows if t]
        found = letter_words([t.encode() for _, t in kept]) if kept else Words(np.zeros(0, np.uint64), np.zeros(1, int))
        counts = np.diff(found.starts)
        self.ids = [i for i, _ in kept]
        self.words = found.hashes
        self.item = np.repeat(np.arange(len(counts)), counts)
        left = found.starts[1:][self.item] - np.arange(len(self.item))
        width = np.minimum(counts, window)[self.item]
        self.suffixes = np.flatnonzero(left >= width)
        self.left, self.width = left[self.suffixes], width[self.suffixes]
        self.depth = int(counts.max(initial=1))

    def matches(self, found: Words) -> list[list[tuple[int, int, int]]]:
        """Per document of a shard: (item, first word, words) of its longest matches."""
        n_docs = len(found.starts) - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_docs)]
        if not len(self.suffixes) or not len(found.hashes):
            return out
        doc = np.repeat(np.arange(n_docs), np.diff(found.starts))
        shard = np.full(len(doc) + n_docs, _BETWEEN, dtype=np.uint64)
        shard[np.arange(len(doc)) + doc] = found.hashes
        suffixes = SuffixArray(shard, self.depth)
        longest = suffixes.longest(self.words, self.suffixes, self.left)
        hit = np.flatnonzero(longest >= self.width)
        q, width = self.suffixes[hit], self.width[hit]
        lo = suffixes.place(self.words, q, width)
        times = suffixes.place(self.words, q, width, after=True) - lo
        if not times.sum():
            return out
        begin = np.concatenate([[0], np.cumsum(np.diff(found.starts) + 1)])
        item = self.item[q]
        by_item = np.lexsort((lo, item))
        edges = np.flatnonzero(np.append(True, np.diff(item[by_item]) != 0))
        for own in np.split(by_item, edges[1:]):
            # Windows of one item have one length: equal ones have one range of suffixes.
            own = own[np.append(True, np.diff(lo[own]) != 0) & (times[own] > 0)]
            if not len(own):
                continue
            at = np.sort(np.concatenate([suffixes.order[lo[k] : lo[k] + times[k]] for k in own]))
            n = int(width[own[0]])
            first = np.flatnonzero(np.append(True, np.diff(at) >= n))
            last = np.append(first[1:], len(at)) - 1
            of = np.searchsorted(begin, at[first], side="right") - 1
            number = int(item[own[0]])
            for d, a, m in zip(of.tolist(), (at[first] - begin[of]).tolist(), (at[last] - at[first] + n).tolist(), strict=True):
                out[d].append((number, a, m))
        return out


@functools.lru_cache(maxsize=1)
def _test_items(folder: str, window: int) -> TestItems:
    """A block of items, as the tasks of a worker open it."""
    store, path = FileSystem.from_uri(folder)
    if store.get_file_info(path).type == FileType.NotFound:
        return TestItems([], window)
    held = dataset(path, filesystem=store, format="parquet").to_table(columns=["item_id", "text"])
    return TestItems(list(zip(*(c.to_pylist() for c in held.columns), strict=True)), window)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with ``n_words`` and ``matches``: item, first word and words of what windows of it cover."""
    items = benchmark.select("item_id", "text")
    kind = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block")
    folder = scratch_path(docs.sparkSession, "items")
    items.select("*", block).repartition("block").write.partitionBy("block").parquet(folder)
    found = T.ArrayType(
        T.StructType(
            [T.StructField("item_id", kind), T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())]
        )
    )
    fields = [T.StructField("n_words", T.LongType()), T.StructField("matches", found)]

    def compute():
        def made(column: pa.Array) -> list:
            batch = utf8(column)
            n_words, matches = [], []
            for lo, hi in slices(batch, SHARD_BYTES):
                words = letter_words(batch[lo:hi])
                n_words += np.diff(words.starts).tolist()
                own: list[list[tuple]] = [[] for _ in range(hi - lo)]
                for k in range(n_blocks):
                    tests = _test_items(f"{folder}/block={k}", window)
                    for place, new in zip(own, tests.matches(words), strict=True):
                        place += [(tests.ids[i], a, n) for i, a, n in new]
                matches += own
            return [n_words, matches]

        return made

    return add_columns(docs, [text], fields, compute)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside matches, and the items matched."""
    spans = F.expr("array_sort(transform(matches, m -> struct(m.first as a, m.first + m.words as b)))")
    covered = F.expr(
        "aggregate(spans, struct(cast(0 as bigint) as n, 0 as upto), (s, x) -> "
        "struct(s.n + greatest(0, x.b - greatest(x.a, s.upto)) as n, greatest(s.upto, x.b) as upto)).n"
    )
    items = F.expr("array_sort(array_distinct(transform(filter(matches, m -> m.item_id is not null), m -> cast(m.item_id as string))))")
    found = find_matches(docs.select("doc_id", "text"), benchmark, window)
    return (
        without(found, ["text"])
        .withColumns({"spans": spans, "items": items})
        .select(
            "doc_id",
            "n_words",
            covered.alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.size("matches") > 0).alias("contaminated"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark window."""
    given = docs.columns
    held = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    found = find_matches(held, benchmark, window).where(F.size("matches") == 0)
    return found.select(*[F.col(f"doc.`{c}`").alias(c) for c in given])
