"""Encoding against the public library itself, and the shapes of odd input."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.bpe import SCANNED, VOCABULARY, WordBpe, decode, encode, tokenized
from millrace.llm.queries import QUERIES

ODD = [
    "", " ", "\n\t", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ß ẞ", "a<|endoftext|>b <|startoftext|>", "<|x|> <|",
    "it's I'LL don't 'S", "\x1c\x1d\x85 ​﻿　é é", "１２３ ٣ ²½ Ⅷ", "日本語 한국어",
    "\x00\x01a\x7f", "🙂👩‍👩‍👧", "x" * (SCANNED - 1), "x" * 5000, "thethe" * 300, "a b́ ́c",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_odd_texts(library):
    bpe = WordBpe(VOCABULARY)
    for text in ODD:
        ids = bpe.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    bpe = WordBpe(VOCABULARY)
    for word in (b"understanding", b"aaaaaaaaaaaaaaaa", bytes(range(33, 127)), b"nternationalinternational"):
        parts = [bpe.inner[b] for b in word[:-1]] + [bpe.last[word[-1]]]
        assert bpe._scanned(list(parts)) == bpe._heaped(list(parts))


def test_query_against_library(spark, sf_dir, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: expected(library, r.text) for r in docs}


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (None, "Hello", "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = tokenized(df, VOCABULARY).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *expected(library, t)) for i, t, _ in rows), key=str)
    assert encode(df, VOCABULARY).columns == ["doc_id", "text", "ids"]
    back = decode(df.selectExpr("cast(null as array<int>) ids", "text as decoded"), VOCABULARY)
    assert [r.decoded for r in back.collect()] == [""] * 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenized(df, VOCABULARY).collect() == []
