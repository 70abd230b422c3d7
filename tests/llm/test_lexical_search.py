"""Ranked search against a plain version that counts words, and odd input."""

import math
import random
import re
from collections import Counter

import pytest

from millrace.llm import lexical_search
from millrace.llm.lexical_search import TermAutomaton, guarded, ranked
from millrace.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, best=50):
    """(item_id, rank, doc_id, score) of (id, text) rows."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, t in items:
        if t is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        found = []
        for doc, counts, n in held:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = 0
            for w in words & counts.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1000000000 * counts[w]) // (1000 * counts[w] + 20 * m))
            if score:
                found.append((score, doc))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, k + 1, doc, score) for k, (score, doc) in enumerate(found[:best])]
    return out


def same(spark, docs, items, best=50, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, ranked(d, i, best, **options).collect()), key=str)
    assert got == sorted(plain(docs, items, best), key=str)


def test_outputs_are_whole_terms():
    automaton = TermAutomaton([(1, ["The cat, the É"]), (2, ["at"])])
    n, counts = automaton.count("the cat at THE catthe the_the É é".encode())
    assert n == len(terms("the cat at THE catthe the_the É é"))
    assert sorted(counts.values()) == [1, 1, 1, 4]  # É, cat, at, the
    assert guarded("aB-c".encode()) == b" ab c "


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "THE", "the", "x1"]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(i, text(rng.randrange(1, 60)) + rng.choice(["", ".", " - ", "\n"])) for i in range(400)]
    return docs + docs[:30], [(i, text(rng.randrange(1, 12))) for i in range(25)]


@pytest.mark.parametrize("best", [1, 7, 50])
def test_plain_version(spark, corpus, best):
    same(spark, *corpus, best)


def test_items_in_blocks_and_small_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 60)
    same(spark, *corpus, 5, block_bytes=200)


def test_ties_repeats_and_missing_ids(spark):
    docs = [(3, "a b"), (1, "a b"), (1, "a b"), (None, "a b"), (2, "a b"), (5, ""), (6, None), (7, "--"), (8, "c " * 50)]
    items = [(1, "A"), (1, "b z"), (2, None), (3, ""), (4, "nowhere"), (None, "c a"), (9, "a, B.")]
    same(spark, docs, items)
    same(spark, docs, items, 2)


def test_empty_tables(spark):
    same(spark, [], [(1, "a")])
    same(spark, [(1, "a")], [])
    same(spark, [(1, "a")], [(1, None)])


def test_a_very_long_text_and_clashing_columns(spark):
    docs = [(1, "alpha beta " * 100_000), (2, "alpha"), (3, "gamma")]
    items = [(1, "alpha gamma")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, ITEM_ID int, score string")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    got = ranked(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs, items)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op13_lexical_search"](spark, sf_dir).collect()))
    assert got == sorted(plain(docs, items))
