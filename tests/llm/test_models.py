"""Classifiers on rows whose labels they have not seen, and odd input."""

import zlib

import numpy as np
import pytest

from millrace.llm import quality_model, toxicity
from millrace.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"
#: Query, label, fold, threshold, and what to expect of some 3000 labelled rows.
CASES = [
    ("op2_toxicity", "toxic", 4, 2, 0.3, 0.96, 0.94),
    ("op10_quality_model", "quality", 3, 1, 0.5, 0.98, 0.97),
]


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = labels.sum()
    return (rank[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


@pytest.mark.parametrize("name,label,of,which,threshold,area,right", CASES)
def test_held_out_rows(spark, name, label, of, which, threshold, area, right):
    rows = QUERIES[name](spark, LARGER).collect()
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == which) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    labels = np.array([truth[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), labels) > area
    assert (np.array([r.predicted for r in held]) == labels).mean() > right


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_odd_input(spark, module, label):
    rows = [(1, None, 1), (1, None, 1), (None, "x", 2), (3, "", 3), (4, "long " * 50_000, 4), (5, "good text", 5), (6, "bad text", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE int")
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1), (3, None), (99, 1)], f"doc_id long, {label} int")
    got = module.scored(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 3)}) == 1
    none = module.scored(docs, labels.where("1 = 0")).collect()
    assert len({r.score for r in none}) == 1
    one_class = module.scored(docs, labels.where(f"{label} = 1")).collect()
    assert len({r.score for r in one_class}) == 1
    assert module.scored(docs.where("1 = 0"), labels).collect() == []


def test_label_model_trusts_the_better_voters():
    r = np.random.default_rng(1)
    truth = (r.random(4000) < 0.2).astype(int)
    vote = lambda right: np.where(r.random(4000) < right, truth, 1 - truth) * 2 - 1
    good = [vote(0.9), vote(0.9), vote(0.85)]
    bad = vote(0.55)
    votes = np.stack([*good, bad, bad, bad], axis=1).astype(float)
    model = toxicity.LabelModel(votes)
    assert ((model.posterior > 0.5) == truth).mean() > 0.92
    assert model.weights[3:].max() < 0.6 < model.weights[:3].min()


def test_gradients_agree_with_differences():
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 5, 130, 700, 2000)]
    target = np.array([0, 1, 1, 0, 1], np.float32)
    net = quality_model.Network()
    net.p["out"] = r.normal(0, 0.5, net.p["out"].shape).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = np.clip(net.scores(texts), 1e-12, 1 - 1e-12)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    found = net.gradients(texts, target)
    for k, v in net.p.items():
        for at in [tuple(r.integers(0, s) for s in v.shape) for _ in range(6)]:
            v[at] += 1e-6
            up = loss()
            v[at] -= 2e-6
            down = loss()
            v[at] += 1e-6
            assert found[k][at] == pytest.approx((up - down) / 2e-6, abs=2e-4)


def test_chunks_cover_every_byte():
    for n in (1, 4, 5, 100, 127, 128, 129, 1000):
        first, starts = quality_model._chunks(np.array([n, 1, n]))
        seen = {i for f in first[starts[2] :] for i in range(f, min(f + quality_model.CHUNK, 2 * n + 1))}
        assert seen == set(range(n + 1, 2 * n + 1))
    data, segments = quality_model.padded([b"a" * 124, b"b" * 125, b""])
    assert segments.tolist() == [2, 2, 1] and len(data) == 5 * 128


def test_scores_do_not_depend_on_neighbours():
    texts = [b"alpha beta " * k for k in (0, 1, 7, 400, 3)]
    net = quality_model.Network()
    net.p["out"] += 0.3
    alone = np.concatenate([net.scores([t]) for t in texts])
    assert np.allclose(net.scores(texts), alone, atol=1e-6)
