"""Ranked lexical search of items in whole texts, by one automaton over all item terms.

Terms are runs of ASCII letters, digits and non-ASCII characters; only A-Z count as lower
case. All terms of the items, each between two guards, go into an Aho-Corasick automaton.
Texts get guards in place of what separates terms, so the automaton's outputs are whole
terms, counted straight from the text: no index of the documents is made. An output leads
to the items that hold the term.

Documents are scanned twice: once for how many have each term, and for the numbers that all
weights need; then for scores. Each task keeps the best documents of an item only, and tasks
are merged in groups. Items are taken in blocks of bounded size, each with an automaton that
is broadcast and removed again; a further block costs two further scans.

Null and empty texts have no terms; such documents count nowhere, such items match nothing.
Rows of equal item_id are one item with the terms of all of them; items without id are one
item. Repeated documents are ranked each for itself, and those without id last among equal
scores. Empty tables give no rows. Columns but the ids and texts are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import parts, saved, utf8
from millrace.operators.feeds import last_n

#: Documents listed for an item.
BEST = 50
#: Bytes of item text in one automaton.
BLOCK_BYTES = 2 << 20
#: Scores held at once: documents times items.
CELLS = 4 << 20

GUARD = b" "
#: Every byte as it counts in a term, or the guard.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else GUARD[0] for b in range(256)
)


def guarded(text: bytes) -> bytes:
    """The text with its terms in lower case between guards."""
    return GUARD + text.translate(_TERMS) + GUARD


class TermAutomaton:
    """Terms of some items, found in texts; and the items of each term."""

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.ids = [i for i, _ in items]
        of: dict[bytes, set[int]] = {}
        for number, (_, held) in enumerate(items):
            for text in held:
                for term in guarded(text.encode()).split():
                    of.setdefault(term, set()).add(number)
        self.n_terms = len(of)
        lists = [np.array(sorted(numbers), dtype=np.int64) for numbers in of.values()]
        self.items = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        # Bytes go in as characters of one byte each.
        self.found = ahocorasick.Automaton()
        for number, term in enumerate(of):
            self.found.add_word((GUARD + term + GUARD).decode("latin-1"), number)
        if of:
            self.found.make_automaton()

    def count(self, text: bytes) -> tuple[int, Counter]:
        """Terms of a text, and how often each of the items' terms occurs."""
        marked = guarded(text)
        n = len(marked.split())
        if not n or not self.n_terms:
            return n, Counter()
        return n, Counter(map(itemgetter(1), self.found.iter(marked.decode("latin-1"))))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def statistics(docs: DataFrame, automaton: Broadcast) -> DataFrame:
    """Documents per term, tasks added up; without term: documents that have terms, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton.value
        df = np.zeros(terms.n_terms, dtype=np.int64)
        n_docs = total = 0
        for batch in (part for whole in batches for part in parts(whole)):
            for text in utf8(batch.column(0)):
                n, counts = terms.count(text)
                n_docs += n > 0
                total += n
                df[list(counts)] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None, *used.tolist()], pa.int64()),
                pa.array([n_docs, *df[used].tolist()], pa.int64()),
                pa.array([total, *[0] * len(used)], pa.int64()),
            ],
            names=["term", "n", "total"],
        )

    rows = docs.select("text").mapInArrow(run, "term long, n long, total long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class _Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, keep: int):
        self.keep = keep
        self.least = np.zeros(n_items, dtype=np.int64)
        self.item, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs: list = []
        self.waiting = 0

    def add(self, scores: np.ndarray, docs: list) -> None:
        """Scores by document and item."""
        # Equal scores stay: the smaller id wins, and it may come later.
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.new.append((item, scores[doc, item], doc + len(self.docs)))
        self.docs += docs
        self.waiting += len(doc)
        if self.waiting > 4 * self.keep * len(self.least) + (1 << 16):
            self.settle()

    def settle(self) -> None:
        """Keep the best of each item; ids of documents decide among equal scores, none comes last."""
        self.item, self.score, self.row = (np.concatenate([a, *b]) for a, b in zip((self.item, self.score, self.row), zip(*self.new, strict=True) if self.new else ((), (), ()), strict=True))
        ids = [self.docs[r] for r in self.row]
        order = sorted(range(len(ids)), key=lambda i: (self.item[i], -self.score[i], ids[i] is None, ids[i] or 0))
        item = self.item[order]
        first = np.searchsorted(item, item, "left")
        kept = np.array(order, dtype=np.int64)[np.arange(len(item)) - first < self.keep]
        self.item, self.score = self.item[kept], self.score[kept]
        self.docs = [ids[i] for i in kept]
        self.row = np.arange(len(kept))
        counts = np.bincount(self.item, minlength=len(self.least))
        full = np.flatnonzero(counts == self.keep)
        self.least[full] = self.score[np.cumsum(counts)[full] - 1]
        self.new, self.waiting = [], 0


def _scores(terms: TermAutomaton, weights: np.ndarray, found: list[tuple[int, Counter]], n_docs: int, total: int) -> np.ndarray:
    """Scores of some documents by document and item, in whole numbers."""
    n_items = len(terms.ids)
    doc = np.repeat(np.arange(len(found)), [len(c) for _, c in found])
    term = np.fromiter((t for _, c in found for t in c), dtype=np.int64, count=len(doc))
    tf = np.fromiter((k for _, c in found for k in c.values()), dtype=np.int64, count=len(doc))
    n = np.array([n for n, _ in found], dtype=np.int64)
    m = 100 - 50 + (50 * n * n_docs) // max(total, 1)
    value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    times = np.diff(terms.starts)[term]
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    cell = np.repeat(doc, times) * n_items + terms.items[np.repeat(terms.starts[term], times) + inside]
    # Sums stay far below 2^53, where doubles hold whole numbers exactly.
    sums = np.bincount(cell, weights=np.repeat(value, times), minlength=len(found) * n_items)
    return sums.astype(np.int64).reshape(len(found), n_items)


def best_documents(docs: DataFrame, automaton: Broadcast, weights: np.ndarray, n_docs: int, total: int, best: int) -> DataFrame:
    """Per task and item the number of the item and its best documents with their scores."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    id_type = pa.int64() if isinstance(schema["doc_id"].dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton.value
        kept = _Best(len(terms.ids), best)
        at_once = max(1, min(512, CELLS // max(1, len(terms.ids))))
        for batch in (part for whole in batches for part in parts(whole)):
            ids, held = batch.column(0).to_pylist(), utf8(batch.column(1))
            for lo in range(0, len(ids), at_once):
                found = [terms.count(t) for t in held[lo : lo + at_once]]
                kept.add(_scores(terms, weights, found, n_docs, total), ids[lo : lo + at_once])
        kept.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept.item, pa.int64()), pa.array(kept.docs, id_type), pa.array(kept.score, pa.int64())], names=schema.names
        )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _block(spark: SparkSession, items: DataFrame, docs: DataFrame, best: int) -> DataFrame:
    """Ranking for the items of one block, written."""
    rows = items.groupBy("item_id").agg(F.collect_set("text").alias("texts")).collect()  # BLOCK_BYTES of text or so
    automaton = TermAutomaton([(r.item_id, r.texts) for r in rows])
    sent = spark.sparkContext.broadcast(automaton)
    counted = {r.term: r for r in statistics(docs, sent).collect()}  # a row per term of the block
    weights = np.zeros(automaton.n_terms, dtype=np.int64)
    n_docs, total = (counted[None].n, counted[None].total) if None in counted else (0, 0)
    for term, row in counted.items():
        if term is not None:
            weights[term] = weight(n_docs, row.n)
    found = best_documents(docs, sent, weights, n_docs, total, best)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = last_n(found, ["item"], order, best)
    rank = F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)")
    kind = items.schema["item_id"].dataType
    names = spark.createDataFrame([(n, i) for n, i in enumerate(automaton.ids)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    ranked = found.withColumn("rank", rank).join(names, "item").select("item_id", "rank", "doc_id", "score")
    ranked = saved(ranked, "ranked")
    sent.destroy()
    return ranked


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item its ``best`` documents by score: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    usable = items.where(F.col("text").isNotNull()).select("item_id", "text")
    of = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    return reduce(DataFrame.unionAll, [_block(spark, usable.where(of == b), docs, best) for b in range(n_blocks)])
