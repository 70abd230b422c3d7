"""Packing documents into windows of fixed length, by the sum-of-squares rule.

A document is its token ids and an id that ends it. What fills whole windows is cut off; the
rest is placed online: of all levels to which partly filled windows are filled, and a new
window, the one is taken after which the squared numbers of windows at each level sum up to
least. A level array holds these numbers. Each task packs the rows of its partition as they
come, and no row is moved.

Open windows are bounded. Beyond the bound, and when the rows end, the fullest windows are
closed: what they lack is cut from the emptiest ones. The last window of a task is cut into
windows of 1024, 512, ... tokens, lengths that need no padding. So no token is padding, and
memory does not depend on the rows: ``OPEN`` windows and one document are held.

A null text counts as empty: its document is the ending id alone. Repeated rows and rows
without id are documents of their own. Columns but id and text are not used. An empty table
gives no pieces. Numbers of windows follow the partitions: write the result before it is
used twice if the order of the rows is not fixed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from millrace.llm.bpe import byte_letters
from millrace.llm.common import parts, texts

LENGTH = 2048
#: The id that ends a document.
END = 1
#: Open windows of a task.
OPEN = 1024
#: Rows of a result batch.
ROWS = 2048
#: Texts between spaces whose ids are remembered in a Python worker; emptied when full.
REMEMBERED = 400_000
#: May follow a word; none of these is a letter, a digit or white space.
_AFTER = ".,;:!?)\"'-"
#: Letters that have one form only and whose lower case is one letter too.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: The letters that stand for bytes in the vocabulary, where they are not those of Latin-1.
_LETTERS = byte_letters()


class WordIds:
    """Ids of texts by the public library, remembered for each text between spaces.

    No word of such a vocabulary holds white space, so a text's ids are those of its pieces
    in a row, little-endian 32-bit numbers here.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            return b"".join([self.known.get(p) or self._piece(p) for p in pieces])

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if len(self.known) >= REMEMBERED:
            self.known = {"": b""}
        word = piece.rstrip(_AFTER)
        if _LATIN(word):
            # What the library makes of such letters and what follows them, without its other steps.
            low = word.lower()
            found = self.known.get(low)
            if found is None:
                letters = low if low.isascii() else low.encode().decode("latin-1").translate(_LETTERS)
                found = self.known[low] = _bytes([t.id for t in self.model.tokenize(letters)])
            if len(word) < len(piece):
                after = piece[len(word) :]
                found += self.known.get(after) or self._whole(after)
            self.known[piece] = found
            return found
        return self._whole(piece)

    def _whole(self, piece: str) -> bytes:
        found = self.known[piece] = _bytes(self.library.encode(piece, add_special_tokens=False).ids)
        return found


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One per Python worker, with its memory of words."""
    return WordIds(path)


@dataclass
class Piece:
    """Ids of a document from its id number ``start`` on."""

    doc: int | None
    start: int
    ids: np.ndarray
    total: int


@dataclass
class Window:
    """Pieces in a row, and how many ids they have."""

    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)

    def cut(self, n: int) -> list[Piece]:
        """Take its last n ids away, as pieces."""
        taken = []
        while n:
            last = self.pieces.pop()
            keep = max(0, len(last.ids) - n)
            if keep:
                self.pieces.append(Piece(last.doc, last.start, last.ids[:keep], last.total))
            taken.append(Piece(last.doc, last.start + keep, last.ids[keep:], last.total))
            n -= len(last.ids) - keep
            self.fill -= len(last.ids) - keep
        return taken[::-1]


class SumOfSquares:
    """Partly filled windows by level, and the rule that places pieces among them."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        #: Windows filled to each level; that of full ones stays 0.
        self.levels = np.zeros(length + 1, dtype=np.int64)
        self.windows: list[list[Window]] = [[] for _ in range(length)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level to place a piece at, 0 for a new window; the fullest of equal ones."""
        there = np.flatnonzero(self.levels[: self.length - size + 1])[::-1]
        after = there + size
        # one window less at its level, one more at the new one unless that is full
        change = 2 - 2 * self.levels[there] + 2 * self.levels[after]
        change[after == self.length] -= 1
        fresh = 2 * self.levels[size] + 1 if size < self.length else 0
        if not len(there) or change.min() > fresh:
            return 0
        return int(there[np.argmin(change)])

    def add(self, piece: Piece) -> Iterator[Window]:
        """Place a piece; yields windows that are full."""
        level = self.level_for(len(piece.ids))
        window = self._taken(level) if level else Window()
        window.put(piece)
        yield from self._back(window)
        if self.open > self.most:
            yield from self.settle(self.most // 2)

    def _taken(self, level: int) -> Window:
        self.levels[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _back(self, window: Window) -> Iterator[Window]:
        if window.fill == self.length:
            yield window
        elif window.fill:
            self.levels[window.fill] += 1
            self.windows[window.fill].append(window)
            self.open += 1

    def settle(self, left: int) -> Iterator[Window]:
        """Fill the fullest windows from the emptiest until so many are open."""
        while self.open > max(left, 1):
            full = self._taken(int(np.flatnonzero(self.levels)[-1]))
            empty = self._taken(int(np.flatnonzero(self.levels)[0]))
            for piece in empty.cut(min(self.length - full.fill, empty.fill)):
                full.put(piece)
            yield from self._back(full)
            yield from self._back(empty)

    def end(self) -> Iterator[Window]:
        """Close all windows; the last one in lengths that are powers of two."""
        yield from self.settle(1)
        while self.open:
            rest = self._taken(int(np.flatnonzero(self.levels)[0]))
            while rest.fill:
                last = Window()
                for piece in rest.cut(1 << (rest.fill.bit_length() - 1)):
                    last.put(piece)
                yield last


def windows_of(documents: Iterator[tuple[int | None, np.ndarray]], length: int = LENGTH, most: int = OPEN) -> Iterator[Window]:
    """Closed windows with all ids of the documents (number, ids)."""
    packer = SumOfSquares(length, most)
    for doc, ids in documents:
        n = len(ids)
        for start in range(0, n - n % length, length):
            whole = Window()
            whole.put(Piece(doc, start, ids[start : start + length], n))
            yield whole
        if n % length:
            yield from packer.add(Piece(doc, n - n % length, ids[n - n % length :], n))
    yield from packer.end()


def packed(
    docs: DataFrame, vocabulary: str | Callable[[], str], length: int = LENGTH, end: int = END, most: int = OPEN
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, doc_tokens, sequence_id,
    offset, and the piece's ids as unsigned little-endian 32-bit numbers."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(vocabulary() if callable(vocabulary) else vocabulary)
        last = _bytes([end])

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in (part for whole in batches for part in parts(whole)):
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    yield doc, np.frombuffer(words.encode(text) + last, dtype="<u4")

        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*rows, strict=True))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=arrow.names)

        for window in windows_of(documents(), length, most):
            at = 0
            for p in window.pieces:
                rows.append((p.doc, p.start, len(p.ids), p.total, number, at, p.ids.tobytes()))
                at += len(p.ids)
            number += 1
            if len(rows) >= ROWS:
                yield made()
        if rows:
            yield made()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pieces(docs: DataFrame, vocabulary: str | Callable[[], str]) -> DataFrame:
    """Per piece: its document, place and size, and a checksum of its ids."""
    found = packed(docs, vocabulary)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
