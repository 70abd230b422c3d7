"""Scores of fitted models against plain versions that go text by text."""

import math
import random

import numpy as np

from millrace.llm import toxicity
from millrace.llm.quality_model import CHUNK, FILTERS, SEGMENT, STEP, WIDTH, Network


def plain_quality(net, text):
    p = {k: v.astype(float) for k, v in net.p.items()}
    filters = np.concatenate([p["near"], p["far"]]).reshape(WIDTH, -1, FILTERS)
    n = (len(text) + 2 * STEP - 1) // (SEGMENT * STEP) + 1
    data = text.ljust(n * SEGMENT * STEP, b"\0")
    answers = []
    for i in range(n * SEGMENT - 1):
        window = data[i * STEP : i * STEP + WIDTH]
        answers.append(p["bias"] + sum(p["embed"][b] @ filters[k] for k, b in enumerate(window)))
    answers.append(answers[-1])  # the last window would reach beyond the padding
    tops = [np.maximum(np.max(answers[s * SEGMENT : (s + 1) * SEGMENT], axis=0), 0) for s in range(n)]
    chunks, at = [], 0
    while True:
        chunks.append(np.max(tops[at : at + CHUNK], axis=0))
        if at + CHUNK >= n:
            break
        at += CHUNK - 1
    seen = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + math.exp(-float(seen @ p["out"] + p["top"][0])))


def test_quality_network():
    net, r = Network(seed=3, bias=0.2), np.random.default_rng(3)
    net.p["out"] = r.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
    net.p["bias"] = r.normal(0, 0.1, FILTERS).astype(np.float32)
    texts = [b"", b"a", b"x" * 119, b"y" * 120, b"z" * 121, *[bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (5, 128, 400, 900, 2500)]]
    assert np.allclose(net.scores(texts), [plain_quality(net, t) for t in texts], atol=1e-4)


def test_toxicity_classifier():
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 30))).encode() for _ in range(300)]
    labels = np.array([b"w1 " in t or b"w2 " in t for t in texts], dtype=np.int64)
    model = toxicity.fit(texts, labels)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def plain(text):
        _, keys = toxicity.features([text])
        total = model.bias + sum(weights.get(k, 0.0) for k in set(keys.tolist()))
        return 1 / (1 + math.exp(-max(-30, min(30, total))))

    assert weights and np.allclose(model.scores(texts), [plain(t) for t in texts])
