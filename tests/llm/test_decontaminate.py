"""Windows of benchmark items against a plain search, and odd input."""

import random
import re

import numpy as np

from millrace.llm.common import letter_words, slices
from millrace.llm.decontaminate import SuffixArray, TestItems, clean_documents, contamination, find_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(window, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item_id)) if item_id is not None else None
    return len(w), len(hit), len(found), bool(hit)


def test_suffix_array_is_sorted():
    r = np.random.default_rng(1)
    w = r.integers(1, 4, 500).astype(np.uint64)
    order = SuffixArray(w, 600).order
    assert order.tolist() == sorted(range(500), key=lambda i: w[i:].tolist())


def test_longest_match():
    text, test = letter_words([b"a b c d e a b c x"]), letter_words([b"a b c x y"])
    found = SuffixArray(text.hashes, 8)
    assert found.longest(test.hashes, np.array([0, 1, 4]), np.array([5, 4, 1])).tolist() == [4, 3, 0]


def test_random_texts_in_small_blocks(spark):
    r = random.Random(3)
    make = lambda n: " ".join(r.choice(["a", "b", "É", "ß", "9"]) for _ in range(n))
    items = [(i, make(r.randint(1, 14))) for i in range(12)] + [(5, make(12)), (None, make(11)), (7, None), (8, "")]
    docs = [(i, make(r.randint(0, 200))) for i in range(40)] + [(41, None), (42, ""), (None, make(30)), (41, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = [x for x in items if x[1]]
    want = sorted(((i, *expected(t, items, 4)) for i, t in docs), key=str)
    got = contamination(d, b, 4)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in got.collect()), key=str) == want
    parts = find_matches(d, b, 4, block_bytes=40)
    whole = find_matches(d, b, 4)
    key = lambda rows: sorted((str(x.doc_id), x.n_words, sorted(map(str, x.matches))) for x in rows)
    assert key(parts.collect()) == key(whole.collect())


def test_one_word_a_million_times():
    """What a document of one word holds of an item of that word is one match, in bounded memory."""
    import resource

    tests = TestItems([(1, "a " * 100), (2, "a " * 30 + "b"), (3, "c " * 20)], 10)
    found = tests.matches(letter_words([b"a " * 1_000_000, b"b " + b"a " * 12, b"x"]))
    assert sorted(found[0]) == [(0, 0, 1_000_000), (1, 0, 1_000_000)]
    assert sorted(found[1]) == [(0, 1, 12), (1, 1, 12)] and found[2] == []
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2 << 20  # kilobytes, with all that the tests have loaded


def test_twenty_blocks_on_shared_storage(spark):
    r = random.Random(9)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(r.randint(5, 30)))) for i in range(200)]
    docs = [(d, " ".join(["before", *items[d][1].split()[2:14], "after", *items[199 - d][1].split()])) for d in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    parts = find_matches(d, b, 10, block_bytes=size // 20)
    key = lambda df: sorted((x.doc_id, sorted(map(tuple, x.matches))) for x in df.collect())
    assert key(parts) == key(find_matches(d, b, 10))
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in contamination(d, b).collect())) == sorted(
        (i, *expected(t, items)) for i, t in docs
    )


def test_clean_documents_keep_their_columns(spark):
    d = spark.createDataFrame([(1, "one two three", 5), (2, "four", 6), (3, None, 7)], "doc_id long, text string, N_WORDS int")
    b = spark.createDataFrame([(1, "Two three")], "item_id long, text string")
    got = clean_documents(d, b)
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect())) == [(2, "four", 6), (3, None, 7)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert contamination(none, items).collect() == []
    assert [(x.n_words, x.contaminated) for x in contamination(one, items).collect()] == [(2, False)]


def test_words_and_slices():
    batch = ["", "Ab,cD  é_9\x00z", "longerthaneightletters longerthaneightletterx", "x"]
    found = letter_words([t.encode() for t in batch])
    assert np.diff(found.starts).tolist() == [len(words(t)) for t in batch]
    assert len(set(found.hashes.tolist())) == 8
    assert list(slices([b"aa", b"b" * 9, b"c", b"d"], 4)) == [(0, 1), (1, 2), (2, 4)]
