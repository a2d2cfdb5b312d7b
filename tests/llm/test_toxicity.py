"""The toxicity classifier against plain versions: every score by hand, the fit by a dense optimiser."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity
from ledgerlens.llm.common import documents
from tests.llm.by_hand import places_by_hand, score_by_hand


def test_every_score_by_hand(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(text)
    for r in got:
        assert r["score"] == pytest.approx(score_by_hand(text[r["doc_id"]], weights, bias), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@pytest.mark.parametrize("swap_weight", [0.0, 5.0])
def test_fit_against_a_dense_optimiser(swap_weight):
    """The objective written out over dense rows, minimised by proximal gradient steps: the fit comes as low."""
    rnd = random.Random(4)
    filler = [f"word{i}" for i in range(30)]
    texts, label = [], []
    for i in range(160):
        toxic = i % 3 == 0
        words = rnd.choices(filler, k=8) + ["vileword"] * toxic + ["muslims"] * (rnd.random() < (0.6 if toxic else 0.1)) + ["old"] * (rnd.random() < 0.2)
        texts.append(" ".join(words))
        label.append(float(toxic))
    label, n = np.array(label), len(texts)
    own = [places_by_hand(t) for t in texts]
    swaps = [(a, places_by_hand(t)) for a, others in zip(own, toxicity.swapped(texts), strict=True) for t in others]
    assert swaps
    count = {}
    for p in (p for a in own for p in a):
        count[p] = count.get(p, 0) + 1
    names = sorted({p for p, c in count.items() if c >= 3} | {p for a, b in swaps for p in a ^ b})
    x = np.array([[float(p in a) for p in names] for a in own])
    s = np.array([[float(p in b) - float(p in a) for p in names] for a, b in swaps])
    decay, sparse = 1e-3, 2e-4

    def smooth(w):
        z = x @ w[:-1] + w[-1]
        return np.logaddexp(0, z).mean() - (label * z).mean() + decay / 4 * w[:-1] @ w[:-1] + swap_weight * ((s @ w[:-1]) ** 2).mean()

    def gradient(w):
        e = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - label) / n
        return np.append(x.T @ e + decay / 2 * w[:-1] + 2 * swap_weight / len(s) * s.T @ (s @ w[:-1]), e.sum())

    objective = lambda w: smooth(w) + sparse * np.abs(w[:-1]).sum()
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(label.mean() / (1 - label.mean()))
    bound = np.linalg.norm(np.c_[x, np.ones(n)], 2) ** 2 / (4 * n) + decay + 2 * swap_weight * np.linalg.norm(s, 2) ** 2 / len(s)
    y, last, t = w.copy(), w.copy(), 1.0
    for _ in range(6000):
        w = y - gradient(y) / bound
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - sparse / bound, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, last = w + (before - 1) / t * (w - last), w
    text = np.concatenate([np.array(sorted(a), np.int64) for a in own])
    changes = [np.array(sorted(b - a) + [-1 - p for p in sorted(a - b)], np.int64) for a, b in swaps]
    weights, bias = toxicity.fit(text, np.array([len(a) for a in own]), label, np.concatenate(changes), np.array([len(c) for c in changes]), swap_weight=swap_weight)
    fitted = np.append(weights[names], bias)
    rest = np.ones(toxicity.PLACES, bool)
    rest[names] = False
    assert not weights[rest].any()
    start = np.zeros_like(fitted)
    start[-1] = np.log(label.mean() / (1 - label.mean()))
    assert objective(fitted) - objective(w) < 0.02 * (objective(start) - objective(w))
    assert ((x @ fitted[:-1] + fitted[-1] > 0) == (x @ w[:-1] + w[-1] > 0)).mean() > 0.98


def test_features_of_a_batch_are_those_by_hand():
    texts = ["Vile WORDS, é-word 12345678", "", None, "a", "muslims and jews"]
    place, doc = toxicity.distinct_places(toxicity.term_tokens(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert set(place[doc == i].tolist()) == places_by_hand(t)
