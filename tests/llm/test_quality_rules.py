"""Counts against a plain version, fences against exact quantiles, and odd input."""

import random
import re
from collections import Counter

from millrace.llm.quality_rules import MIN_DOCS, passing, verdicts
from millrace.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t\x0b\x0c\r ", "a", "a b c d e", "a b c d e f", "a " * 12, "é x\n\né x\n", "#|<>\n#|<>", "  \U0001f600"]
    texts += ["".join(r.choice("aab \n\t#f") for _ in range(r.randint(0, 150))) for _ in range(400)]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(200)]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id: base(r) for r in verdicts(df).collect()} == {i: counts(t) for i, t in enumerate(texts)}


def test_table_against_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op7_quality_rules"](spark, sf_dir).collect()
    assert {r.doc_id: base(r) for r in rows} == {r.doc_id: counts(r.text) for r in docs}
    assert not [r for r in rows if r.base_failed and r.kept]
    kept = {r.doc_id: r.kept or r.base_failed for r in rows}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [kept[x.doc_id] for x in labels if x.quality == 1]
    assert sum(good) >= 0.98 * len(good)
    judged = {r.doc_id: r.kept for r in rows}
    junk = [judged[x.doc_id] for x in labels if x.quality == 0]
    assert sum(junk) <= 0.1 * len(junk)


def clean(r, n=40):
    return " ".join("".join(r.choice("abcde") for _ in range(r.randint(3, 6))) for _ in range(n))


def test_fences_follow_their_group(spark):
    """Symbols are usual in one source and odd in another; a small one follows its language."""
    r = random.Random(3)
    noisy = lambda: " ".join(x + "##" for x in clean(r).split())
    rows = [(i, clean(r), "en", "plain") for i in range(200)] + [(200, noisy(), "en", "plain")]
    rows += [(300 + i, noisy(), "en", "marked") for i in range(MIN_DOCS)]
    rows += [(500, noisy(), "en", "small"), (501, clean(r), "en", "small"), (502, clean(r), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in verdicts(df).collect()}
    assert not kept[200] and not kept[500] and kept[501] and kept[502]
    assert all(kept[i] for i in range(200)) and all(kept[300 + i] for i in range(MIN_DOCS))


def test_passing_keeps_rows_as_they_came(spark):
    r = random.Random(4)
    text = clean(r)
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, None, None, 2), (2, None, "en", "s", 3), (3, "x", "en", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, KEPT int")
    got = passing(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:3], key=str)
    assert passing(df.where("1 = 0")).collect() == [] == verdicts(df.where("1 = 0")).collect()
