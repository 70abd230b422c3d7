"""Repeated blocks of lines, by aligning pairs of overlapping documents.

Documents that share blocks meet through hashes of runs, the shortest ranges of consecutive
lines with ``MIN_WORDS`` words: each later document is paired with the first document that
has the run, so a run in n documents makes n - 1 pairs at most, however frequent it is, and
a pair holds the lines of its common runs only. A patience diff aligns the pair: lines that
are unique on both sides are anchors, their longest ordered chain splits the texts, and the
parts between are aligned likewise. What it leaves of the later document is aligned again
with runs for lines, each by its first place, until no run is left. Aligned
blocks of consecutive lines with ``MIN_WORDS`` words or more are deleted from the later
document, the one with the larger doc_id. The first document of a block keeps it, as often
as it holds it.

Words stand between white space; in scripts without spaces each character but a mark counts
as one. Lines are compared without the white space at their ends; blank lines neither count nor
part a block, and stay. Null and empty texts have no lines and are left alone, as are rows
without id. Rows that repeat id and text get equal results; rows of equal id but other
text are not compared with each other; which of them is a line's first is settled by a
digest. Only hashes and word counts of shared lines are
shuffled for the search.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_columns, saved, without

#: Words of a block that is deleted, at least.
MIN_WORDS = 30

#: Scripts written without spaces: each of their characters but marks counts as a word.
_UNSPACED = "".join(rf"\\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
_WORD = rf"[{_UNSPACED}&&[^\\p{{M}}]]|[^ \\t\\r\\x0B\\f{_UNSPACED}]+"
#: Where those scripts lie, with others: lines without such characters are counted faster.
_HIGH = r"[\\u0E00-\\u109F\\u1780-\\u17FF\\u19E0-\\u19FF\\u2E80-\\x{10FFFF}]"
_BLANK = r"' \t\r\u000b\u000c'"


def _lines() -> Column:
    """Number, place, hash and words of each line with a word."""
    split = r"transform(split(coalesce(text, ''), '\n', -1), (l, i) -> struct(i AS place, trim(BOTH " + _BLANK + " FROM l) AS l))"
    return F.expr(
        f"transform(filter({split}, x -> x.l <> ''), (x, k) -> struct(k AS number, x.place AS place, xxhash64(x.l) AS h, "
        f"CASE WHEN octet_length(x.l) > length(x.l) AND x.l RLIKE '{_HIGH}' THEN regexp_count(x.l, '{_WORD}') "
        r"ELSE regexp_count(x.l, '[^ \\t\\r\\x0B\\f]+') END AS words))"
    )


def shared_lines(docs: DataFrame) -> DataFrame:
    """Lines that two documents have at least."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("of"), F.explode(_lines()).alias("l")
    )
    lines = saved(lines.select("doc_id", "of", "l.*"), "lines")
    several = lines.groupBy("h").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b")
    # Written, so that a line that very many documents have is joined in parts.
    return saved(lines.join(saved(several.select("h"), "shared-hashes"), "h"), "shared-lines")


def runs(words: list[int], numbers: list[int], min_words: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive lines with ``min_words`` words: the shortest from and to each line.

    Every line of a block that is long enough lies in such a range inside the block.
    """
    end = total = 0
    for start in range(len(words)):
        if end < start or (end > start and numbers[end - 1] != numbers[start] + end - 1 - start):
            end, total = start, 0
        while total < min_words and end < len(words) and numbers[end] == numbers[start] + end - start:
            total, end = total + words[end], end + 1
        if total >= min_words:
            yield start, end
        total -= words[start] if end > start else 0
    start = total = 0
    for end in range(1, len(words) + 1):
        if end > 1 and numbers[end - 1] != numbers[end - 2] + 1:
            start, total = end - 1, 0
        total += words[end - 1]
        while total - words[start] >= min_words:
            total, start = total - words[start], start + 1
        if total >= min_words:
            yield start, end


def sharing_runs(sequences: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs of a later document and the first document of some of its runs of lines: the lines
    of these runs as they stand in both.

    A run in n documents makes n - 1 pairs at most. Each line of a block that any earlier
    document has lies in a run of that block, whose first document is an earlier one too.
    """

    def compute():
        def made(column: pa.Array) -> list:
            out = []
            for lines in column.to_pylist():
                raw = array("q", [x["h"] for x in lines]).tobytes()
                found = runs([x["words"] for x in lines], [x["number"] for x in lines], min_words)
                digests = {(i, k): hashlib.blake2b(raw[8 * i : 8 * k], digest_size=8).digest() for i, k in found}
                out.append([(int.from_bytes(d, "little", signed=True), i + 1, k - i) for (i, k), d in digests.items()])
            return [out]

        return made

    run = T.StructType([T.StructField("run", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())])
    found = add_columns(sequences, ["lines"], [T.StructField("runs", T.ArrayType(run, False))], compute)
    # Cut before they are exploded: a row never holds more than a run has.
    cut = F.transform("runs", lambda r: F.struct(r["run"].alias("run"), F.slice("lines", r["at"], r["size"]).alias("lines")))
    found = saved(found.select("doc_id", "of", F.explode(cut).alias("r")).select("doc_id", "of", "r.*"), "runs")
    number = F.col("lines")[0]["number"]
    first = found.groupBy("run").agg(F.min(F.struct("doc_id", "of", number.alias("number"))).alias("first"), F.max("doc_id").alias("last"))
    first = saved(first.where("first.doc_id < last").drop("last"), "first-runs")
    pairs = found.join(first, "run").where("first.doc_id < doc_id")
    shift = (F.col("first.number") - number).alias("shift")
    lines = pairs.select("doc_id", "of", F.col("first.doc_id").alias("first_id"), F.col("first.of").alias("first_of"), shift, F.explode("lines").alias("l"))
    there = F.struct((F.col("l.number") + F.col("shift")).alias("number"), "l.h", "l.words")
    return lines.groupBy("doc_id", "of", "first_id", "first_of").agg(
        F.sort_array(F.collect_set("l")).alias("lines"), F.sort_array(F.collect_set(there)).alias("earlier")
    )


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of lines of a aligned with equal lines of b, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        chain = _longest_chain(_unique_pairs(a, a0, a1, b, b0, b1))
        if not chain:
            continue
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        out += chain
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def _unique_pairs(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> list[tuple[int, int]]:
    times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {b[j]: j for j in range(b0, b1) if times_b[b[j]] == 1}
    return [(i, place[a[i]]) for i in range(a0, a1) if times_a[a[i]] == 1 and a[i] in place]


def _longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that ascends on both sides, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[pile], ends[pile] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _keyed_runs(lines: list[dict], min_words: int) -> Iterator[tuple[tuple, range]]:
    """The hashes of each run of lines, and the run."""
    hashes = [x["h"] for x in lines]
    for start, end in runs([x["words"] for x in lines], [x["number"] for x in lines], min_words):
        yield tuple(hashes[start:end]), range(start, end)


def repeated(later: list[dict], earlier: list[dict], min_words: int = MIN_WORDS) -> list[int]:
    """Places of the later document's lines in aligned blocks that are long enough.

    An alignment is one to one and in order. What it leaves of the later document is aligned
    again, runs standing for lines, until no run is left that the earlier document has.
    """
    gone: set[int] = set()
    block: list[int] = []
    last = None
    for i, j in [*patience([x["h"] for x in earlier], [x["h"] for x in later]), (None, None)]:
        here = None if i is None else (earlier[i]["number"], later[j]["number"])
        if last is None or here is None or here != (last[0] + 1, last[1] + 1):
            if sum(later[k]["words"] for k in block) >= min_words:
                gone.update(block)
            block = []
        if here is not None:
            block.append(j)
        last = here
    known: dict[tuple, int] = {}
    for key, _ in _keyed_runs(earlier, min_words) if len(gone) < len(later) else ():
        known.setdefault(key, len(known))
    left = [(known[key], places) for key, places in _keyed_runs(later, min_words) if key in known] if known else []
    while left := [(run, places) for run, places in left if not gone.issuperset(places)]:
        first: dict[int, range] = {}
        for run, places in left:
            first.setdefault(run, places)
        here = list(first)
        aligned = patience(sorted(here), here)
        if not aligned:
            break
        for _, j in aligned:
            gone.update(first[here[j]])
    return [later[k]["place"] for k in sorted(gone)]


def repeated_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with repeated blocks: doc_id, digest of the text, places of the lines."""
    shared = shared_lines(docs)
    line = F.struct("number", "place", "h", "words")
    sequences = shared.groupBy("doc_id", "of").agg(F.sort_array(F.collect_set(line)).alias("lines"))
    pairs = sharing_runs(sequences, min_words)

    def compute():
        def made(later: pa.Array, earlier: pa.Array) -> list:
            both = zip(later.to_pylist(), earlier.to_pylist(), strict=True)
            return [[repeated(x, y, min_words) for x, y in both]]

        return made

    field = T.StructField("gone", T.ArrayType(T.IntegerType(), False))
    found = add_columns(pairs.select("doc_id", "of", "lines", "earlier"), ["lines", "earlier"], [field], compute)
    found = found.where(F.size("gone") > 0).groupBy("doc_id", "of")
    return found.agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their repeated blocks deleted from ``text``, and ``n_lines_removed``.

    A document of which no line with a word is left has an empty text.
    """
    names = [c for c in docs.columns if c.lower() != "n_lines_removed"]
    gone = saved(repeated_places(docs, min_words), "gone").withColumnsRenamed({"doc_id": "__id", "of": "__of", "gone": "__gone"})
    held = without(docs, ["n_lines_removed"])
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__of"))
    lines = r"split(text, '\n', -1)"
    text = F.expr(
        "CASE WHEN __gone IS NULL THEN text ELSE transform(array(" + lines + "), v -> "
        r"array_join(transform(array_except(sequence(0, size(v) - 1), __gone), i -> v[i]), '\n'))[0] END"
    )
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.when(F.trim(F.regexp_replace(text, r"[\n\t\r\x0B\f]", " ")) == "", F.lit("")).otherwise(text)
    )
    return (
        # Both sides grow with the input: the same join at every size.
        held.join(gone.hint("merge"), same, "left")
        .withColumn("__text", text)
        .select(
            *[F.col("__text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names],
            F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_lines_removed"),
        )
    )
