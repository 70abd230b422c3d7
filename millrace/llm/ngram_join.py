"""Similarity join on word shingles, by T-occurrence search.

Two documents link when the Jaccard similarity of their shingle sets reaches the threshold.
A set of n shingles can link only with sets that hold T = ceil(threshold * n) of them, so
two linked sets meet in the inverted lists of their n - T + 1 rarest shingles, rarity being
any order that all sets share. It comes from a table of fixed size that counts the shingles
of all documents by ranges of their hashes, so shingles that only one text has come first.
It only decides how short the lists are, never the result.

Equal sets are one node. Nodes lie in shards: a node's shard is that of its longest list,
cut by sizes of sets and where they are many, so that nodes alike mostly lie together. A shard
holds the inverted lists of its nodes' whole sets. Spark moves sets to shards, not pairs: a
query goes once to each shard with which it shares enough rare shingles. There it
is searched by DivideSkip: the longest lists of the query are set aside, the short ones are
merged, the long ones are probed by bisection, and what reaches the required overlap is a
link. A shard passes on links only that join what it has not joined yet.

Two such searches are made. The first has a few nodes of each large shard searched by all of
it, which joins most of a group of copies into one component. The second has all pairs that
share a list and are not in one component: of two components the smaller asks the larger.

A null text or one without words has an empty set and links with nothing. Rows of equal id
are nodes of their own sets. A row without id has no links and no component.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Words, add_columns, grams, mixed, saved, slices, spaced_words, utf8

SHINGLE, PERCENT = 3, 90
#: Size of the table of list lengths, and of a part of it. It orders shingles only.
SLOTS, PART_SLOTS = 1 << 20, 1 << 12
_SLOT_SHIFT = np.uint64(44)
#: Shingles of the sets in one shard, and queries of a shard in one task.
SHARD, TASK = 1 << 20, 4096
#: Nodes of a shard that the first search asks for, where a shard has more.
LEADERS = 16
#: Sizes in one shard: up to this share above the least, as a logarithm.
BAND = 0.05
#: Entries merged on a heap; more are merged by a sort of the lists.
HEAPED = 256
#: Long lists probed before the candidates that cannot reach the overlap are dropped.
PROBED = 96
#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, and where each text's begin. A text of fewer words is one shingle."""
    counts = np.diff(words.starts)
    found, starts = grams(words, n)
    made = np.diff(starts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = [mixed(np.array([0xA5A5 + c], np.uint64))[0] for c in range(n)]
    values = np.zeros(len(short), dtype=np.uint64)
    for k, i in enumerate(short):
        h = whole[counts[i]]
        for w in words.hashes[words.starts[i] : words.starts[i + 1]]:
            h = mixed(np.array([h ^ w], np.uint64))[0]
        values[k] = h
    out = np.insert(found, starts[short], values)
    made = made.copy()
    made[short] = 1
    return out, np.concatenate([[0], np.cumsum(made)])


def list_levels(docs: DataFrame, n_words: int = SHINGLE) -> np.ndarray:
    """How long inverted lists are, for each of ``SLOTS`` ranges of shingle hashes.

    A count of all shingles of all documents in a table of fixed size. Tables of the tasks
    are added up in parts. Level 0 is the mean; each level above is a quarter of a doubling.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            held = utf8(batch.column(0))
            for lo, hi in slices(held, SLICE_BYTES):
                found, _ = shingles(spaced_words(held[lo:hi]), n_words)
                table += np.bincount((found >> _SLOT_SHIFT).astype(np.int64), minlength=SLOTS)
        rows = table.reshape(-1, PART_SLOTS).astype("<u4")
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["part", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(part, np.zeros(PART_SLOTS, dtype=np.int64))
                sums[part] += np.frombuffer(counts, dtype="<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"]
        )

    schema = "part long, counts binary"
    added = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    total = np.zeros((SLOTS // PART_SLOTS, PART_SLOTS))
    for row in added.collect():  # at most SLOTS / PART_SLOTS rows
        total[row.part] = np.frombuffer(row.counts, dtype=np.int64)
    levels = np.round(4 * np.log2((total.ravel() + 1) / (total.mean() + 1)))
    return np.clip(levels, 0, 127).astype(np.int8)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def with_sets(docs: DataFrame, levels: np.ndarray, percent: int, n_words: int = SHINGLE) -> DataFrame:
    """doc_id, size and digest of the set, and its rarest shingles: enough to meet any link."""

    def compute():
        def made(column: pa.Array) -> list:
            held = utf8(column)
            sizes, digests, rare = [], [], []
            for lo, hi in slices(held, SLICE_BYTES):
                found, starts = shingles(spaced_words(held[lo:hi]), n_words)
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    own = np.unique(found[a:b])
                    n = len(own)
                    order = np.lexsort((own, levels[(own >> _SLOT_SHIFT).astype(np.int64)]))
                    sizes.append(n)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    rare.append(own[order[: n - least_overlap(n, percent) + 1]].view(np.int64) if n else [])
            return [sizes, digests, rare]

        return made

    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("rare", T.ArrayType(T.LongType(), False)),
    ]
    return add_columns(docs.select("doc_id", "text"), ["text"], fields, compute).drop("text")


def whole_sets(docs: DataFrame, n_words: int = SHINGLE) -> DataFrame:
    """docs with the digest of the set and all its shingles in ascending order, without text."""

    def compute():
        def made(column: pa.Array) -> list:
            held = utf8(column)
            digests, sets = [], []
            for lo, hi in slices(held, SLICE_BYTES):
                found, starts = shingles(spaced_words(held[lo:hi]), n_words)
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    own = np.unique(found[a:b])
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sets.append(own.tobytes())
            return [digests, sets]

        return made

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("items", T.BinaryType())]
    return add_columns(docs, ["text"], fields, compute).drop("text")


class DivideSkip:
    """Inverted lists over the sets of a shard, searched for sets that share enough with a query."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        items = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((of, items))
        self.items, self.of = items[order], of[order]

    def search(self, query: np.ndarray, percent: int, wanted: np.ndarray | None = None) -> list[int]:
        """Numbers of the sets whose similarity to the query reaches the threshold, of those wanted."""
        # shared >= percent / 100 * union, with union = both sizes less the shared.
        n = len(query)
        need = -(-percent * (n + self.sizes) // (100 + percent))
        usable = need <= np.minimum(n, self.sizes)
        if wanted is not None:
            usable &= wanted
        if not usable.any():
            return []
        least = int(need[usable].min())
        lo = np.searchsorted(self.items, query, "left")
        hi = np.searchsorted(self.items, query, "right")
        there = np.flatnonzero(hi > lo)
        if len(there) < least:
            return []
        there = there[np.argsort(lo[there] - hi[there], kind="stable")]
        lo, hi = lo[there], hi[there]
        long = min(least - 1, int(least / (0.001 * np.log2(1 + hi[0] - lo[0]) + 1)))
        found, times = self._merged(lo[long:], hi[long:], least - long)
        kept = usable[found]
        found, missing = found[kept], need[found[kept]] - times[kept]
        # The shorter of the long lists are probed first: they tell sets apart sooner.
        for first in range(long, 0, -PROBED):
            part = slice(max(0, first - PROBED), first)
            open_ = missing > 0
            if not open_.any():
                break
            missing[open_] -= self._probed(lo[part], hi[part], found[open_])
            kept = missing <= part.start
            found, missing = found[kept], missing[kept]
        return found[missing <= 0].tolist()

    def _merged(self, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that stand in least of these lists or more, ascending, and in how many."""
        if (hi - lo).sum() <= HEAPED:
            pairs = list(self._merge([self.of[a:b].tolist() for a, b in zip(lo, hi, strict=True)], least))
            found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            return found[:, 0], found[:, 1]
        entries = np.sort(np.concatenate([self.of[a:b] for a, b in zip(lo, hi, strict=True)]), kind="stable")
        first = np.flatnonzero(np.append(True, entries[1:] != entries[:-1]))
        times = np.diff(np.append(first, len(entries)))
        enough = times >= least
        return entries[first[enough]], times[enough]

    def _probed(self, lo: np.ndarray, hi: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """In how many of these lists each of the sets stands, by bisection of all lists at once."""
        lo = np.repeat(lo, len(sets)).reshape(len(lo), -1)
        end = hi[:, None]
        hi = np.repeat(hi, len(sets)).reshape(len(hi), -1)
        for _ in range(int((end[:, 0] - lo[:, 0]).max()).bit_length()):
            mid = (lo + hi) >> 1
            less = (self.of[np.minimum(mid, end - 1)] < sets) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        return ((lo < end) & (self.of[np.minimum(lo, end - 1)] == sets)).sum(axis=0)

    @staticmethod
    def _merge(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
        """Numbers that stand in least lists or more, with how many lists hold them."""
        heap = [(ids[0], k, 0) for k, ids in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) >= least:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                yield top, len(popped)
                for _, k, at in popped:
                    if at + 1 < len(lists[k]):
                        heapq.heappush(heap, (lists[k][at + 1], k, at + 1))
                continue
            # What the popped lists hold below the next top can't stand in enough lists.
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            top = heap[0][0]
            for _, k, at in popped:
                at = bisect_left(lists[k], top, at)
                if at < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at], k, at))


def placed_sets(docs: DataFrame, firsts: DataFrame, places: DataFrame, n_words: int) -> DataFrame:
    """``places`` with the whole set of each node, made once a node from its first document.

    places: node, component, members, shard, task and kind (0 is asked for, 1 asks).
    """
    place = F.struct("shard", "task", "kind")
    wanted = places.groupBy("node", "component", "members").agg(F.collect_list(place).alias("places"))
    wanted = saved(wanted.join(firsts, "node"), "wanted")
    # Both sides grow with the input: the same join at every size.
    sets = whole_sets(docs.join(wanted.hint("merge"), "doc_id").drop("doc_id"), n_words)
    sets = sets.where(F.xxhash64("digest") == F.col("node"))
    return sets.select("node", "component", "members", F.explode("places").alias("p"), "items").select("p.*", "node", "component", "members", "items")


def asked_in_tasks(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Nodes by shard, task and kind. index, queries: shard and node.

    A shard with very many queries is searched in several tasks, each of which has all its lists.
    """
    tasks = queries.groupBy("shard").agg(F.ceil(F.count("*") / TASK).alias("tasks"))
    index = index.join(tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    queries = queries.join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks")))
    return index.select("node", "shard", "task", F.lit(0).alias("kind")).unionAll(
        queries.select("node", "shard", "task", F.lit(1).alias("kind"))
    )


def searched(rows: DataFrame, percent: int, ordered: bool) -> DataFrame:
    """Links between components, found in shards: pairs a, b.

    rows: shard, task, kind (0 is asked for, 1 asks), node, component, members and the
    set. With ``ordered``, a node asks only for those of larger components, or of equally
    large ones with a greater number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, lists, top = None, [], None, {}

        def find(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c] = top.get(top[c], top[c])
            return c

        for batch in batches:
            found: list[tuple[int, int]] = []
            for number, task, kind, component, size, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (number, task) != shard:
                    shard, held, lists, top = (number, task), [], None, {}
                own = np.frombuffer(items, dtype=np.uint64)
                if kind == 0:
                    held.append((own, component, size))
                    continue
                if not held:
                    continue
                if lists is None:
                    lists = DivideSkip([h[0] for h in held])
                    of = [h[1] for h in held]
                    first, sizes = np.array(of, dtype=np.int64), np.array([h[2] for h in held], dtype=np.int64)
                    places: dict[int, list[int]] = {}
                    for k, c in enumerate(of):
                        places.setdefault(c, []).append(k)
                    now = first.copy()
                mine = find(component)
                wanted = now != mine
                if ordered:
                    wanted &= (sizes > size) | ((sizes == size) & (first > component))
                for k in lists.search(own, percent, wanted):
                    other, mine = find(of[k]), find(component)
                    if other != mine:
                        found.append((component, of[k]))
                        # The one with fewer places is renamed.
                        if len(places.get(other, ())) > len(places.get(mine, ())):
                            other, mine = mine, other
                        top[other] = mine
                        moved = places.pop(other, [])
                        now[moved] = mine
                        places.setdefault(mine, []).extend(moved)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
                )

    rows = rows.select("shard", "task", "kind", "component", "members", "items", "node")
    rows = rows.repartition("shard", "task").sortWithinPartitions("shard", "task", "kind", "node").drop("node")
    return saved(rows.mapInArrow(run, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """component and where it goes, for the components that edges (a, b) join.

    A round has each follow its neighbour of least priority, if that is less than its own, and
    the one that this follows, and so on for some steps; then the edges between what is left
    remain. Priorities are hashes: local minima are few in any graph, and stay for good.
    """
    priority = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(0)).alias("p"), F.col(c).alias("c"))

    def moved(df: DataFrame, c: str, lead: DataFrame) -> DataFrame:
        lead = lead.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        return df.join(lead, F.col(c) == F.col("_a"), "left").withColumn(c, F.coalesce("_to", c)).drop("_a", "_to")

    edges = saved(edges.where("a <> b").distinct(), "edges")
    label = edges.select(F.explode(F.array("a", "b")).alias("component")).distinct()
    label = label.withColumn("to", F.col("component"))
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lead = both.groupBy("a").agg(F.least(priority("a"), F.min(priority("b")))["c"].alias("to"))
        lead = saved(lead.where("a <> to"), "leads")
        for _ in range(2):  # to that of that
            lead = saved(moved(lead, "to", lead), "leads")
        label = saved(moved(label, "to", lead), "components")
        edges = saved(moved(moved(edges, "a", lead), "b", lead).where("a <> b").distinct(), "edges")
    return label


def shards(lists: DataFrame) -> DataFrame:
    """node and shard: that of its longest list and its size, cut by a hash of the node if sets are many."""
    sizes = saved(lists.groupBy("item").agg(F.count("*").alias("entries")), "sizes")
    longest = lists.join(sizes, "item").groupBy("node").agg(
        F.max("n").alias("n"), F.max(F.struct("entries", "item"))["item"].alias("item")
    )
    longest = saved(longest, "longest")
    longest = longest.withColumn("band", F.floor(F.log("n") / BAND))
    cuts = longest.groupBy("item", "band").agg(F.ceil(F.sum("n") / SHARD).alias("cuts"))
    cut = F.pmod(F.xxhash64("node", F.lit(0)), F.col("cuts"))
    return longest.join(cuts, ["item", "band"]).select("node", F.xxhash64("item", "band", cut).alias("shard"))


def with_components(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """node, its component after merging, and how many members that has."""
    moved = nodes.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    moved = saved(moved, "components")
    return moved.join(moved.groupBy("component").agg(F.count("*").alias("members")), "component")


def visits(lists: DataFrame, nodes: DataFrame, placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Shards and nodes that are asked for, and shards with the nodes that ask there.

    Of two linked sets one has its rare shingles wholly below the other's last one; those that
    are not shared are missing from the overlap. So they share T - max(T of each) + 1 rare
    shingles, T being the overlap that the pair needs. A node asks in a shard that has so many of
    its rare shingles, for the size there that needs least, and a node that belongs to a
    component that comes later, by members and number.
    """
    entries = lists.join(nodes, "node").join(placed, "node").withColumn("rank", F.struct("members", "component"))
    several = entries.groupBy("item").agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
    entries = saved(entries.join(several.where("_a <> _b").select("item"), "item"), "open-lists")
    routes = entries.groupBy("item", "shard").agg(
        F.max("rank").alias("_rank"), F.min("n").alias("_least"), F.max("n").alias("_most")
    )
    near = (F.col("n") * 100 >= F.col("_least") * percent) & (F.col("_most") * 100 >= F.col("n") * percent)
    asking = entries.drop("shard").join(routes, "item").where(near & (F.col("rank") < F.col("_rank")))
    asking = asking.groupBy("node", "n", "shard").agg(
        F.count("*").alias("shared"), F.min("_least").alias("_least"), F.max("_most").alias("_most")
    )

    def needed(size):  # without rounding, which only makes more of it; least at the ends of a range of sizes
        return percent * (F.col("n") + size) / (100 + percent) - percent * F.greatest(F.col("n"), size) / 100

    ends = [F.greatest(F.col("_least"), percent * F.col("n") / 100), F.least(F.col("_most"), 100 * F.col("n") / percent)]
    asking = asking.where(F.col("shared") > F.least(*map(needed, ends)) - 1e-6)
    asking = saved(asking.select("shard", "node"), "asking")
    held = entries.select("node", "shard").distinct().join(asking.select("shard").distinct(), "shard", "left_semi")
    return held, asking


def joined(docs: DataFrame, percent: int = PERCENT, n_words: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, size of its shingle set, smallest doc_id that links lead to."""
    docs = docs.select("doc_id", "text")
    found = saved(with_sets(docs, list_levels(docs, n_words), percent, n_words), "sets")
    usable = found.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # A node is a set, numbered by its digest: rows of equal id may have different ones.
    number = F.xxhash64("digest")
    same = saved(usable.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("node", number), "nodes")
    entries = usable.select(number.alias("node"), "n", F.explode("rare").alias("item"))
    several = entries.groupBy("item").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a < _b")
    lists = saved(entries.join(several.select("item"), "item").distinct(), "lists")
    placed = saved(shards(lists), "shards")
    merged = None
    if not placed.isEmpty():
        firsts = same.select("node", F.col("first").alias("doc_id"))
        # The first search: every node of a large shard asks a few of them, which also ask each other.
        members = placed.groupBy("shard").agg(F.count("*").alias("of")).where(F.col("of") > LEADERS)
        leads = F.pmod(F.xxhash64("node", F.lit(1)), F.col("of")) < LEADERS
        kinds = F.explode(F.when(leads, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("kind")
        nodes = placed.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("members"))
        places = placed.join(members, "shard").select("node", "shard", F.lit(0).cast("long").alias("task"), kinds).join(nodes, "node")
        links = searched(placed_sets(docs, firsts, places, n_words), percent, ordered=False)
        nodes = saved(with_components(nodes.drop("members"), components(links)), "first-components")
        # The second: what shares enough and is not in one component yet.
        places = asked_in_tasks(*visits(lists, nodes, placed, percent)).join(nodes, "node")
        links = searched(placed_sets(docs, firsts, places, n_words), percent, ordered=True)
        merged = saved(with_components(nodes.drop("members"), components(links)), "merged")

    smallest = same.join(merged, "node") if merged is not None else same.withColumn("component", F.col("node")).where("1 = 0")
    least = smallest.groupBy("component").agg(F.min("first").alias("least"))
    moved = smallest.join(least, "component").where("least < first").select("digest", "least")
    firsts = same.select("digest", "first").join(saved(moved, "moved"), "digest", "left")
    rows = found.select("doc_id", "n", "digest").join(firsts, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "first")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, n_words: int = SHINGLE) -> DataFrame:
    """The documents that lead their component, as they came; those without id stay."""
    led = saved(joined(docs, percent, n_words), "joined").where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(led.hint("merge"), "doc_id", "left_anti")
