"""Packing: all ids once, full windows, the placing rule against a plain version, and odd input."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.bpe import VOCABULARY
from millrace.llm.packing import END, LENGTH, SumOfSquares, WordIds, packed, windows_of
from millrace.llm.queries import QUERIES

ODD = [
    "", " ", "a  b", "Über-Straße, naïve.", "don't 'S it's\n\nNew\tline", "x<|endoftext|>y", "ΑΣ Σ. é é", "日本語 한국어, ok!", "İ ǅ ß º ª", "１２３ 4,5",
    "word joined wide", "--- ... ?!", "a" * 3000,
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, END]


def test_ids_are_those_of_the_library(library):
    words = WordIds(VOCABULARY)
    for _ in range(2):  # the second time from memory
        for text in ODD:
            assert [*np.frombuffer(words.encode(text), "<u4").tolist(), END] == ids_of(library, text), text


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = WordIds(VOCABULARY)
    for text in ODD * 2:
        assert [*np.frombuffer(words.encode(text), "<u4").tolist(), END] == ids_of(library, text)
        assert len(words.known) <= 8


def plain_level(levels, size, length):
    """The level whose choice leaves the least sum of squares; the fullest of equal ones, then a new window."""
    best = None
    for level in range(length - size, -1, -1):
        if level and not levels[level]:
            continue
        after = dict(enumerate(levels))
        if level:
            after[level] -= 1
        if level + size < length:
            after[level + size] += 1
        total = sum(n * n for n in after.values())
        if best is None or total < best[0]:
            best = (total, level)
    return best[1]


def test_levels_are_chosen_as_by_trying_all():
    rng = random.Random(1)
    for _ in range(300):
        packer = SumOfSquares(length=12)
        for level in range(1, 12):
            packer.levels[level] = rng.choice([0, 0, 1, 2, 3])
        size = rng.randrange(1, 13)
        assert packer.level_for(size) == plain_level(packer.levels, size, 12)


@pytest.mark.parametrize("most", [1, 3, 50])
@pytest.mark.parametrize("length", [16, 64])
def test_every_id_lies_in_one_full_window(length, most):
    rng = random.Random(length + most)
    docs = [(i, np.arange(rng.choice([1, 2, length - 1, length, 3 * length + 5, rng.randrange(1, length)])) + 1000 * i) for i in range(200)]
    seen, odd = defaultdict(list), []
    for window in windows_of(iter(docs), length, most):
        assert sum(len(p.ids) for p in window.pieces) == window.fill <= length
        if window.fill < length:
            odd.append(window.fill)
        for p in window.pieces:
            assert len(p.ids) and p.total == len(docs[p.doc][1])
            seen[p.doc].append((p.start, p.ids))
    assert all(n & (n - 1) == 0 for n in odd) and len(odd) == len(set(odd))
    for i, ids in docs:
        got = sorted(seen[i], key=lambda x: x[0])
        assert [s for s, _ in got] == np.cumsum([0, *[len(x) for _, x in got]])[:-1].tolist()
        assert np.concatenate([x for _, x in got]).tolist() == ids.tolist()


def test_documents_stay_whole_where_they_can():
    """Without the bound nothing but the last windows is cut."""
    docs = [(i, np.arange(n)) for i, n in enumerate([8, 8, 4, 12, 16, 2, 14] * 20)]
    cut = {p.doc for w in windows_of(iter(docs), 16, 10_000) for p in w.pieces if len(p.ids) < p.total}
    assert not cut


def check(rows, docs, library):
    """rows of the query against what the library gives for (doc_id, text) rows of distinct ids."""
    texts = dict(docs)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        ids, at = ids_of(library, texts[doc]), 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            piece = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(ids)
    for found in by_window.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == LENGTH or at & (at - 1) == 0 and at < LENGTH


def test_query(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(QUERIES["op12_packing"](spark, sf_dir).collect(), docs, library)


def test_odd_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, None), (None, "no id", "x"), (101, "long " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, LENGTH string").repartition(3)
    got = packing.pieces(df, VOCABULARY).collect()
    check(got, [(i, t) for i, t, _ in rows], library)
    assert packing.pieces(df.where("1 = 0"), VOCABULARY).collect() == []
    twice = packing.pieces(df.unionAll(df), VOCABULARY)
    assert twice.selectExpr("sum(length)").first()[0] == 2 * sum(r.length for r in got)
    ids = packed(df.where("doc_id = 100"), VOCABULARY).collect()
    assert [(r.length, r.doc_tokens, bytes(r.ids)) for r in ids] == [(1, 1, b"\x01\x00\x00\x00")]
