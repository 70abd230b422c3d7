"""Links and components against all pairs."""

import random
import re

import numpy as np

import pytest

from millrace.llm import ngram_join
from millrace.llm.common import spaced_words
from millrace.llm.ngram_join import DivideSkip, joined, one_of_each, shingles
from millrace.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and a is not None and rows[j][0] is not None and 100 * both >= 90 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted(((a, len(s), None if a is None else least[find(i)]) for i, ((a, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, joined(df).collect()), key=str) == expected(rows)


def test_shingles_of_every_length():
    batch = ["", "a", "A b", "a b c", "x a b c a b c", "a b", "ab", "b a"]
    found, starts = shingles(spaced_words([t.encode() for t in batch]))
    got = [frozenset(found[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    want = [frozenset(shingle_set(t)) for t in batch]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(8) for j in range(8))
    assert len(got[3] & got[4]) == 1


@pytest.mark.parametrize(("heaped", "probed"), [(256, 96), (0, 3), (10**9, 1)])
def test_divide_skip_finds_all(monkeypatch, heaped, probed):
    monkeypatch.setattr(ngram_join, "HEAPED", heaped)
    monkeypatch.setattr(ngram_join, "PROBED", probed)
    r = random.Random(4)
    for _ in range(150):
        base = r.sample(range(1000), r.randint(1, 60))
        make = lambda: np.unique([x if r.random() < 0.95 else r.randrange(2000) for x in base]).astype(np.uint64)
        sets = [make() for _ in range(r.randint(1, 30))] + [np.array([5000], np.uint64)]
        query = make()
        want = [
            i for i, s in enumerate(sets)
            if 100 * len(np.intersect1d(s, query)) >= 90 * len(np.union1d(s, query))
        ]
        assert DivideSkip(sets).search(query, 90) == want
        some = np.array([r.random() < 0.5 for _ in sets])
        assert DivideSkip(sets).search(query, 90, some) == [i for i in want if some[i]]


def near(r, words, changes):
    out = list(words)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"n{r.randrange(10**6)}"
    return " ".join(out)


def test_families_chains_and_odd_texts(spark):
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    rows, base = [], [r.choice(vocabulary) for _ in range(200)]
    rows += [(i, near(r, base, r.randint(0, 6))) for i in range(60)]
    chain = [f"c{i}" for i in range(300)]
    for i in range(60, 110):
        rows.append((i, " ".join(chain)))
        for k in range(3):
            chain[((i - 60) * 6 + k) % 300] = f"d{i}x{k}"
    rows += [(200 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a"), (304, "A"), (305, "a b"), (None, "a b"), (None, None), (306, "A  B")]
    rows += [(310, "same id one"), (310, "same id two"), (309, "same ID two"), (310, "same id two")]
    r.shuffle(rows)
    check(spark, rows)


def test_groups_cut_over_many_shards_and_tasks(spark, monkeypatch):
    """Near copies of which many pairs are close to the threshold, few leaders, small shards."""
    monkeypatch.setattr(ngram_join, "SHARD", 3000)
    monkeypatch.setattr(ngram_join, "TASK", 7)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    r = random.Random(12)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        rows += [(len(rows), near(r, base, r.choice([1, 2, 3, 4]))) for _ in range(70)]
    common = [f"passage{i}" for i in range(40)]
    rows += [(len(rows) + i, " ".join(common + [f"o{i}x{k}" for k in range(i % 9)])) for i in range(60)]
    r.shuffle(rows)
    check(spark, rows)


def test_same_as_all_pairs_on_the_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_ngram_join"](spark, sf_dir).collect()), key=str) == expected(rows)


def test_one_of_each_keeps_columns(spark):
    rows = [(2, "a b c d", 1), (1, "a b c d", 2), (3, "x", 3), (4, None, 4), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[4]], key=str)


def test_empty_table(spark):
    assert joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []
