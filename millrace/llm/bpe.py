"""Byte-pair encoding and decoding with a public vocabulary of word-end tokens.

Each word is merged in a contiguous rank array: the ids of its parts, and beside each
part the rank of merging it with the next. The least rank is found by a scan, a boundary
goes, and the two neighbouring ranks are looked up again. Long words, for which repeated
scans would be slow, take the same merges from a heap.

Null texts count as empty and give no tokens. Repeated rows get equal results; other
columns stay, but for those named like the new ones.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_columns, texts

#: A public vocabulary; any other file of its kind will do.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def public_vocabulary() -> str:
    """The same file, where the one who calls has it: each executor its own."""
    return public_tokenizers.path("word_bpe_49k.json")


#: Words up to this many bytes are scanned; both ways give the same parts.
SCANNED = 128
#: Words remembered per Python worker; the memory is emptied when full.
REMEMBERED = 250_000

_NONE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """One vocabulary file: encoding of texts, and decoding of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.made = [vocab[a + b] for a, b in model["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.known: dict[str, list[int]] = {}
        self.merged_words: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.specials.split(text) if "<|" in text else (text,):
            if piece in self.added:
                ids.append(self.added[piece])
                continue
            known = self.known
            # No word holds white space, and white space composes with nothing.
            for chunk in piece.replace("\n", " ").split(" "):
                found = known.get(chunk)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[chunk] = self._chunk(chunk)
                ids += found
        return ids

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of a text without spaces."""
        if chunk.isascii() and chunk.isalpha():
            return self._word(chunk.lower())
        words = self.words(_lower(unicodedata.normalize("NFC", chunk)))
        return self._word(words[0]) if len(words) == 1 else [i for w in words for i in self._word(w)]

    def _word(self, word: str) -> list[int]:
        found = self.merged_words.get(word)
        if found is None:
            if len(self.merged_words) >= REMEMBERED:
                self.merged_words.clear()
            found = self.merged_words[word] = self.merged(word.encode())
        return found

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def merged(self, word: bytes) -> list[int]:
        parts = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._scanned(parts) if len(parts) <= SCANNED else self._heaped(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        rank, made = self.ranks.get, self.made
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            parts[i] = part = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((part, parts[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank((parts[i - 1], part), _NONE)
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(self.ranks.get((parts[i], parts[i + 1]), _NONE), i, parts[i], parts[i + 1]) for i in range(n - 1)]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                heapq.heappush(heap, (self.ranks.get((parts[i], parts[j]), _NONE), i, parts[i], parts[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if rank == _NONE:
                break
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = self.made[rank], True, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p, dead in zip(parts, gone, strict=True) if not dead]


def _lower(text: str) -> str:
    """Lower case letter by letter: a sigma that ends a word is no special case."""
    return text.replace("Σ", "σ").lower()


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> WordBpe:
    """One per Python worker, with its memory of words."""
    return WordBpe(path)


def vocabulary_of(path: str | Callable[[], str]) -> WordBpe:
    """The vocabulary of a path, or of a function that finds the path when a task calls it."""
    return _vocabulary(path() if callable(path) else path)


def encode(df: DataFrame, vocabulary: str | Callable[[], str], text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids of its texts. vocabulary: a path that all executors can open."""

    def compute():
        bpe = vocabulary_of(vocabulary)
        return lambda column: [[bpe.encode(t) for t in texts(column)]]

    return add_columns(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], compute)


def decode(df: DataFrame, vocabulary: str | Callable[[], str], ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the texts that its token ids stand for; null ids count as none."""

    def compute():
        bpe = vocabulary_of(vocabulary)

        def made(column: pa.Array) -> list:
            return [[bpe.decode(x or []) for x in column.to_pylist()]]

        return made

    return add_columns(df, [ids], [T.StructField(text, T.StringType())], compute)


def encode_and_decode(
    df: DataFrame, vocabulary: str | Callable[[], str], text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """df with the ids of its texts and what these ids decode to, in one pass over the rows."""

    def compute():
        bpe = vocabulary_of(vocabulary)

        def made(column: pa.Array) -> list:
            found = [bpe.encode(t) for t in texts(column)]
            return [found, [bpe.decode(x) for x in found]]

        return made

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())]
    return add_columns(df, [text], fields, compute)


def ids_sha256(ids: str) -> Column:
    """Digest of the decimal ids, joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def tokenized(df: DataFrame, vocabulary: str | Callable[[], str]) -> DataFrame:
    """Per document: token count and the digests of ids and decoded text."""
    made = encode_and_decode(df.select("doc_id", "text"), vocabulary)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_sha256("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
