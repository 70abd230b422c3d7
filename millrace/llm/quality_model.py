"""Quality of a text from its bytes, by a small convolutional network in numpy.

Bytes are embedded; learned filters slide over them; what each filter answers at most is
taken per chunk, and chunks overlap and cover the whole text. The mean and the maximum
over a text's chunks are combined into one probability.

The network is trained in one task on a bounded sample of ``SAMPLE`` labelled rows,
whatever the table's size. Null texts are scored as empty ones, as one chunk of padding.
Without labels, or with one class only, every text gets the same score. Repeated rows get
equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_columns, fitted, held_out, labelled_sample, slices, utf8

#: Labelled rows that the network is trained on, at most (about).
SAMPLE = 4000
THRESHOLD = 0.5

#: Filters see WIDTH bytes and move by STEP; embedded bytes have DEPTH values.
STEP, WIDTH, DEPTH, FILTERS = 4, 8, 8, 24
#: A segment is 128 bytes; a chunk is four segments, the last one shared with the next chunk.
SEGMENT, CHUNK = 32, 4
_SEGMENT_BYTES = SEGMENT * STEP
#: Bytes of text that the filters go over at once.
BLOCK_BYTES = 1 << 18

EPOCHS, BATCH, RATE = 14, 64, 0.01


class Network:
    def __init__(self, seed: int = 7, bias: float = 0.0):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "embed": normal(256, DEPTH, scale=0.5),
            "near": normal(STEP * DEPTH, FILTERS, scale=0.15),
            "far": normal(STEP * DEPTH, FILTERS, scale=0.15),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "top": np.array([bias], np.float32),
        }

    def _filtered(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Answers of the filters at each step; data: bytes, a multiple of the segment.

        The last step of a text, whose window reaches into the next text, answers like the
        one before it: both start in the padding. ``ends`` are these steps.
        """
        p = self.p
        groups = p["embed"][data].reshape(-1, STEP * DEPTH)
        answers = groups @ p["near"] + p["bias"]
        answers[:-1] += (groups @ p["far"])[1:]
        answers[ends] = answers[ends - 1]
        return answers

    def features(self, data: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each text, whose segments follow each other."""
        tops, ends = [], np.cumsum(segments) * SEGMENT - 1
        for lo in range(0, len(data), BLOCK_BYTES):
            # One segment more, so that the block's last window sees what follows.
            part = data[lo : lo + BLOCK_BYTES + _SEGMENT_BYTES]
            n = min(BLOCK_BYTES, len(data) - lo) // _SEGMENT_BYTES
            inside = ends[np.searchsorted(ends, lo // STEP) : np.searchsorted(ends, (lo + len(part)) // STEP)]
            answers = self._filtered(part, inside - lo // STEP)
            tops.append(answers.reshape(-1, SEGMENT, FILTERS)[:n].max(axis=1))
        top = np.maximum(np.concatenate(tops), 0)
        first, starts = _chunks(segments)
        last = np.repeat(np.cumsum(segments), np.diff(np.append(starts, len(first))))
        pooled = top[first]
        for k in range(1, CHUNK):
            pooled = np.maximum(pooled, top[np.minimum(first + k, last - 1)])
        counts = np.diff(np.append(starts, len(first)))[:, None]
        return np.concatenate(
            [np.add.reduceat(pooled, starts) / counts, np.maximum.reduceat(pooled, starts)], axis=1
        )

    def scores(self, batch: list[bytes]) -> np.ndarray:
        found = []
        for lo, hi in slices(batch, 1 << 20):
            data, segments = padded(batch[lo:hi])
            logit = self.features(data, segments) @ self.p["out"] + self.p["top"]
            found.append(1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30))))
        return np.concatenate(found) if found else np.zeros(0)

    def gradients(self, batch: list[bytes], target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss. Only the windows that the maxima come from take part."""
        p = self.p
        data, segments = padded(batch)
        answers = self._filtered(data, np.cumsum(segments) * SEGMENT - 1).reshape(-1, SEGMENT, FILTERS)
        where = answers.argmax(axis=1) + np.arange(len(answers))[:, None] * SEGMENT
        top = answers.max(axis=1)
        first, starts = _chunks(segments)
        counts = np.diff(np.append(starts, len(first)))
        of = np.repeat(np.arange(len(batch)), counts)
        last = np.cumsum(segments)[of]
        inside = np.minimum(first[:, None] + np.arange(CHUNK), last[:, None] - 1)
        best = top[inside].argmax(axis=1)
        segment = np.take_along_axis(inside, best, axis=1)
        value = np.take_along_axis(top, segment, axis=0)
        pooled = np.maximum(value, 0)
        highest = np.maximum.reduceat(pooled, starts)
        seen = np.concatenate([np.add.reduceat(pooled, starts) / counts[:, None], highest], axis=1)
        logit = seen @ p["out"] + p["top"]
        gap = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - target).astype(np.float32) / len(batch)
        out = {"out": seen.T @ gap, "top": gap.sum(keepdims=True)}
        mean_part = (gap / counts)[of][:, None] * p["out"][:FILTERS]
        is_highest = (pooled == highest[of]) & (pooled > 0)
        shared = np.maximum(np.add.reduceat(is_highest, starts), 1)
        highest_part = is_highest * (gap[of][:, None] * p["out"][FILTERS:] / shared[of])
        back = (mean_part + highest_part) * (value > 0)
        place = np.take_along_axis(where, segment, axis=0) * STEP
        windows = data[np.minimum(place[:, :, None] + np.arange(WIDTH), len(data) - 1)]
        inner = np.concatenate([p["near"], p["far"]]).reshape(WIDTH, DEPTH, FILTERS)
        d_inner, d_embed = np.zeros_like(inner), np.zeros_like(p["embed"])
        column = np.arange(FILTERS)
        for k in range(WIDTH):
            told = np.bincount((windows[:, :, k] * np.int64(FILTERS) + column).ravel(), back.ravel(), 256 * FILTERS)
            told = told.reshape(256, FILTERS).astype(np.float32)
            d_inner[k] = p["embed"].T @ told
            d_embed += told @ inner[k].T
        half = STEP * DEPTH
        flat = d_inner.reshape(WIDTH * DEPTH, FILTERS)
        return out | {"near": flat[:half], "far": flat[half:], "bias": back.sum(axis=0), "embed": d_embed}


def padded(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled up with two steps of zeros at least, and the segments of each."""
    segments = np.array([(len(t) + 2 * STEP - 1) // _SEGMENT_BYTES + 1 for t in batch], dtype=np.int64)
    data = b"".join(t.ljust(n * _SEGMENT_BYTES, b"\0") for t, n in zip(batch, segments.tolist(), strict=True))
    return np.frombuffer(data, dtype=np.uint8), segments


def _chunks(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First segment of each chunk, and the first chunk of each text."""
    counts = np.maximum(1, -(-(segments - 1) // (CHUNK - 1)))
    starts = np.cumsum(counts) - counts
    inside = np.arange(counts.sum()) - np.repeat(starts, counts)
    return np.repeat(np.cumsum(segments) - segments, counts) + inside * (CHUNK - 1), starts


def fit(batch: list[bytes], labels: np.ndarray) -> Network:
    share = float(np.clip((labels.sum() + 0.5) / (len(labels) + 1), 0.01, 0.99))
    net = Network(bias=float(np.log(share / (1 - share))))
    if not len(labels) or labels.min() == labels.max():
        return net
    r = np.random.default_rng(11)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(batch))
        rate = RATE * (1 - 0.9 * epoch / EPOCHS)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            step += 1
            for k, g in net.gradients([batch[i] for i in some], labels[some].astype(np.float32)).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                up = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                net.p[k] = (net.p[k] - rate * up).astype(np.float32)
    return net


def with_scores(docs: DataFrame, model: Network, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of each whole text."""

    def compute():
        def made(column: pa.Array) -> list:
            return [model.scores(utf8(column)).tolist()]

        return made

    return add_columns(docs, [text], [T.StructField(score, T.DoubleType())], compute)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    return fitted(labelled_sample(docs, labels, "quality", held_out(3, 1), sample), fit)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether its label was held out, score and prediction."""
    found = with_scores(docs.select("doc_id", "text"), trained(docs, labels))
    return found.select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
