"""Toxicity by weak supervision.

Words and word parts that mark toxic rows of a bounded labelled sample make lexicon and
pattern voters. A generative model of the votes estimates each voter's accuracy without
labels, and how far voters say the same; correlated voters share their weight. A linear
classifier is trained on the model's posterior labels and scores every whole text.

The sample is fitted in one task; its size is ``SAMPLE`` rows, whatever the table's. Null
texts are scored as empty. Without labels, or with one class only, every text gets the
same score. Repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_columns, fitted, held_out, labelled_sample, mixed, slices, utf8, word_parts

#: Labelled rows that the voters and the classifier are fitted on, at most (about).
SAMPLE = 6000
#: Features of the classifier.
FEATURES = 3000
#: Voters made of the marks of one kind.
GROUPS = 4
#: Rows with a mark, at least; log odds from which it speaks for toxicity.
SUPPORT, ODDS = 3, 2.0
THRESHOLD = 0.3

#: Word, its first four to six bytes, its last four.
KINDS = 5


def features(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each word and word part; the lowest three bits tell the kind."""
    found, whole, starts, ends, lengths = word_parts(batch)
    doc = np.repeat(np.arange(len(batch)), np.diff(found.starts))
    keys, docs = [whole], [doc]
    for n in (4, 5, 6):
        long = lengths > n
        keys.append(starts[long] & np.uint64((1 << (8 * n)) - 1))
        docs.append(doc[long])
    long = lengths > 4
    keys.append(ends[long])
    docs.append(doc[long])
    out = [(mixed(k + np.uint64(i + 1)) & np.uint64(0xFFFFFFFFFFFFFFF8)) | np.uint64(i) for i, k in enumerate(keys)]
    return np.concatenate(docs), np.concatenate(out)


class LabelModel:
    """Posterior of the true class given votes of -1, 0 (abstains) or 1."""

    def __init__(self, votes: np.ndarray, rounds: int = 25):
        n, m = votes.shape
        seen = [(votes == v).astype(float) for v in (-1, 0, 1)]
        alike = self._alike(votes)
        self.weights = 1 / (1 + alike.sum(axis=1))
        posterior = 1 / (1 + np.exp(-2.0 * votes @ self.weights))
        for step in range(rounds):
            share = np.clip(posterior.mean(), 0.01, 0.99)
            odds = np.zeros((3, m))
            for k, s in enumerate(seen):
                yes = (posterior @ s + 0.5) / (posterior.sum() + 1.5)
                no = ((1 - posterior) @ s + 0.5) / ((1 - posterior).sum() + 1.5)
                odds[k] = np.log(yes / no)
            if step % 5 == 4:
                both = np.maximum(alike, self._correlations(votes, posterior))
                self.weights = 1 / (1 + both.sum(axis=1))
            told = sum(s @ (self.weights * o) for s, o in zip(seen, odds, strict=True))
            posterior = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + told, -30, 30)))
        self.odds, self.posterior = odds, posterior

    @staticmethod
    def _alike(votes: np.ndarray) -> np.ndarray:
        """Voters that nearly always vote the same: 0 at a correlation of 0.8, 1 at 1.

        Found before the first round, as copies of a voter would pass for the truth.
        """
        rest = votes - votes.mean(axis=0)
        sd = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
        out = np.clip((rest.T @ rest / len(votes) / np.outer(sd, sd) - 0.8) / 0.2, 0, 1)
        np.fill_diagonal(out, 0)
        return out

    @staticmethod
    def _correlations(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """How far two voters go together within a class, beyond what the class explains."""
        total = np.zeros((votes.shape[1],) * 2)
        for p in (posterior, 1 - posterior):
            w = p / max(p.sum(), 1e-9)
            rest = votes - w @ votes
            cov = (rest * w[:, None]).T @ rest
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            total += p.mean() * np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(total, 0)
        return total


class Classifier:
    """Linear in the presence of its features."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def scores(self, batch: list[bytes]) -> np.ndarray:
        total = np.full(len(batch), self.bias)
        if len(self.keys):
            doc, key = features(batch)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            pair = np.unique(doc[hit] * len(self.keys) + at[hit])
            np.add.at(total, pair // len(self.keys), self.weights[pair % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(batch: list[bytes], labels: np.ndarray) -> Classifier:
    share = float(np.clip((labels.sum() + 0.5) / (len(labels) + 1), 0.01, 0.99))
    only_bias = Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    if not len(labels) or labels.min() == labels.max():
        return only_bias
    docs, keys = [], []
    for lo, hi in slices(batch, 4 << 20):
        doc, key = features(batch[lo:hi])
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        docs.append((doc[new] + lo).astype(np.int32))
        keys.append(key[new])
    doc, key = np.concatenate(docs), np.concatenate(keys)
    del docs, keys
    known, index, times = np.unique(key, return_inverse=True, return_counts=True)
    del key
    toxic = np.bincount(index, weights=labels[doc].astype(float), minlength=len(known))
    clean = times - toxic
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    sure = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    sure[times < SUPPORT] = 0
    chosen = np.sort(np.argsort(-np.abs(sure), kind="stable")[:FEATURES])
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[index] >= 0
    x = np.zeros((len(batch), len(chosen)), dtype=np.float32)
    x[doc[kept], place[index[kept]]] = 1
    votes = _votes(x, known[chosen], odds[chosen], sure[chosen])
    target = LabelModel(votes).posterior.astype(np.float32)
    weights, bias = _logistic(x, target)
    return Classifier(known[chosen], weights, bias)


def _votes(x: np.ndarray, keys: np.ndarray, odds: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Votes of each voter on each text.

    A kind's marks of toxicity are dealt to a few voters, which vote 1 where they see one.
    A voter of the kind votes -1 where none of them stands.
    """
    votes = []
    for kind in range(KINDS):
        marks = np.flatnonzero(((keys & np.uint64(7)) == kind) & (odds >= ODDS))
        if not len(marks):
            continue
        marks = marks[np.argsort(-sure[marks], kind="stable")]
        groups = [marks[g::GROUPS] for g in range(min(GROUPS, len(marks)))]
        votes += [(x[:, g].max(axis=1) > 0).astype(float) for g in groups]
        votes.append(-(x[:, marks].max(axis=1) == 0).astype(float))
    return np.stack(votes, axis=1) if votes else np.zeros((len(x), 1))


def _logistic(x: np.ndarray, target: np.ndarray, steps: int = 250, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on soft labels, by accelerated descent."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log(target.mean() / (1 - target.mean())))
    vw, vb = np.zeros_like(w), np.float32(0)
    rate = np.float32(4.0 / max(1.0, float((x**2).sum(axis=1).mean())))
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - target
        vw = 0.9 * vw - rate * (x.T @ gap / len(x) + ridge * w)
        vb = 0.9 * vb - rate * gap.mean()
        w, b = w + vw, b + vb
    return w.astype(float), float(b)


def with_scores(docs: DataFrame, model: Classifier, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of each whole text."""

    def compute():
        def made(column: pa.Array) -> list:
            return [model.scores(utf8(column)).tolist()]

        return made

    return add_columns(docs, [text], [T.StructField(score, T.DoubleType())], compute)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    return fitted(labelled_sample(docs, labels, "toxic", held_out(4, 2), sample), fit)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether its label was held out, score and prediction."""
    found = with_scores(docs.select("doc_id", "text"), trained(docs, labels))
    return found.select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
