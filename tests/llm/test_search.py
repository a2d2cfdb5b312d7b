"""Vector and lexical searches against brute force, with ties, copies, awkward rows and small cells."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lexical, negatives, topk, vectors

VECTORS = "vec_id long, embedding array<float>, label int, rank int, shard string, score double"


def floored(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


@pytest.fixture(scope="module")
def points():
    """600 rows: a third copies of one vector, near copies, signs and lengths that differ, and rows that take no part."""
    rng = np.random.default_rng(5)
    out = []
    hot = rng.normal(size=6)
    for i in range(600):
        v = hot if i % 3 == 0 else hot + 0.02 * rng.normal(size=6) if i % 5 == 0 else rng.normal(size=6) * (1 + i % 4)
        out.append((i, [float(np.float32(x)) for x in v], int(i % 4)))
    out += [(700, None, 1), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (702, [math.nan] * 6, 1), (703, [math.inf] + [0.0] * 5, 1), (None, [1.0] * 6, 1)]
    return out + [(704, [0.0] * 6, None), (800, [0.5, -0.5], 2), (801, [], 3), (50, [1.5] * 6, 2), (100, [2.5] * 6, 1)]


def usable(points, label=False):
    return [(i, floored(v), y) for i, v, y in points if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and not (label and y is None)]


def frame(spark, points):
    return spark.createDataFrame([(i, v, y, 7, "x", 0.5) for i, v, y in points], VECTORS).repartition(5)


@pytest.fixture
def small(monkeypatch):
    for module, name, value in ((vectors, "SHARD_ROWS", 150), (vectors, "GROUP", 3), (topk, "BLOCK_ROWS", 16), (negatives, "BUCKET_ROWS", 32), (lexical, "SHARD_POSTINGS", 900), (lexical, "GROUP_TERMS", 40), (lexical, "CELLS", 6_000), (lexical, "BLOCK", 4)):
        monkeypatch.setattr(module, name, value)


def test_top_k(spark, points, small):
    rows, want = usable(points), []
    for a, (i, q, _) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-inner(q, v), j) for b, (j, v, _) in enumerate(rows) if a != b)[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    got = topk.top_k(frame(spark, points), F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = topk.top_k(frame(spark, points[:3]), F.col("vec_id") == 0, 5).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in few) == [(0, i, inner(floored(points[0][1]), floored(points[i][1]))) for i in (1, 2)]
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0, 5).collect() == []
    assert topk.top_k(frame(spark, points[:1]), F.lit(True), 5).collect() == []


def test_hard_negatives(spark, points, small):
    rows, want = usable(points, True), []
    rows = [(i, v, (y + 1) % 4 if i % 7 == 0 else y) for i, v, y in rows]
    for a, (i, q, y) in enumerate(rows):
        if i % 20 == 0:
            scored = sorted((-inner(q, v), j, z) for b, (j, v, z) in enumerate(rows) if a != b)
            for s, p, _ in [x for x in scored if x[2] == y][:5]:
                fits = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
                want += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(fits, 1)]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    got = negatives.mine(frame(spark, points), F.col("vec_id") % 20 == 0, label)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 20 == 0, label).collect() == []


def test_coordinate_lists_narrow_without_loss(monkeypatch):
    """With a high floor the ranges leave few rows, and all that reach it."""
    rng = np.random.default_rng(2)
    data = rng.normal(size=(2000, 8))
    data = (256 * data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.int64)
    bucket, query = negatives.Bucket(data), data[:40] / np.linalg.norm(data[:40], axis=1, keepdims=True)
    focus = np.argsort(-np.abs(query), axis=1)[:, : negatives.FOCUS]
    floor = 0.9 * 256 * 256
    cosine = np.full(40, floor / (256 * bucket.longest))
    start, stop = bucket.ranges(query, focus, cosine)
    left = [set(bucket.candidates(focus[i], start[i], stop[i]).tolist()) for i in range(40)]
    for i in range(40):
        assert set(np.flatnonzero(256 * query[i] @ data.T >= floor).tolist()) <= left[i]
    assert np.mean([len(x) for x in left]) < 200


def test_blocks_below_the_floor_are_not_scored(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 100
    data = np.concatenate([(c + rng.normal(size=(64, 16))).astype(np.int64) for c in centres])
    shard = vectors.Shard.__new__(vectors.Shard)
    shard.dim, shard.blocks = 16, np.split(data, 40)
    shard.ids = np.split(np.arange(len(data)), 40)
    scored = []
    monkeypatch.setattr(topk, "products", lambda a, b: (scored.append(len(a) * len(b)), vectors.products(a, b))[1])
    key, score, ids = topk.best_in_blocks(shard, data[::64], 5, np.full(40, vectors.LEAST))
    full = data[::64] @ data.T
    for q in range(40):
        best = np.lexsort((np.arange(len(data)), -full[q]))[:5]
        assert sorted(ids[key == q]) == sorted(best)
    assert sum(scored[2:]) < 0.25 * 40 * len(data)


def test_products_are_exact():
    big = np.array([[2**31, -(2**30)], [3, 2**40]])
    assert (vectors.products(big[:1], big[:1]) == [[2**62 + 2**60]]).all()
    assert (vectors.products(big, big[:, ::-1]) == big @ big[:, ::-1].T).all()
    for values in ([0], [127, -128], [128], [-129], [2**31], [-(2**40)]):
        data, width = vectors.to_bytes(np.array(values, np.int64))
        assert vectors.from_bytes(data, width, 0).tolist() == values


def brute_lexical(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in counts:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_lexical_search(spark, small, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"{'éÄß'[i % 3] if i % 5 == 0 else ''}W{i}" for i in range(120)]
    text = lambda n: " ".join(words[min(119, int(rng.exponential(12)))] for _ in range(n))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(180)]
    docs += [(200 + i, "w1 w2 W3, w4;w5") for i in range(90)]  # ties
    docs += [(400, None), (401, ""), (402, " .\t!"), (403, "w1 " * 9_000), (404, text(20_000)), (7, text(9)), (None, text(30)), (405, "word joined w1 w2")]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(25)] + [(30, None), (31, ""), (32, "unheard of"), (33, "w3 W3 w4 w4"), (34, " ".join(words)), (35, "word joined")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n long, term string").repartition(4)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    assert sorted(map(tuple, lexical.lexical_search(frame, asked, 10).collect()), key=str) == brute_lexical(docs, items)
    assert lexical.lexical_search(frame.limit(0), asked, 10).collect() == []
    assert lexical.lexical_search(frame, asked.limit(0), 10).collect() == []


def test_lexical_blocks_are_skipped(monkeypatch):
    """Blocks whose summary can't reach the k-th best score are left out, and the result stays."""
    rng = np.random.default_rng(6)
    topics = [rng.choice(400, 40, replace=False) for _ in range(20)]
    docs = [[f"t{t}" for t in rng.choice(topics[i % 20], 15)] for i in range(2000)]
    counts = [Counter(d) for d in docs]
    table = pa.table({"id": list(range(2000)), "m": [100] * 2000, "terms": [list(c) for c in counts], "tfs": [list(c.values()) for c in counts]})
    terms = [f"t{t}" for t in topics[3][:12]]
    asked = pa.table({"query": [0], "item_id": [0], "terms": [terms], "gains": [[5] * 12], "floor": [0]})
    visited = []
    init = lexical.Query.keep
    monkeypatch.setattr(lexical.Query, "keep", lambda self, s, i: (visited.append(self.seen.sum()), init(self, s, i))[1])
    got = lexical.search_cell(table, asked, 10)
    score = [sum(5 * (10**9 * c[t] // (1000 * c[t] + 800)) for t in terms) for c in counts]
    best = sorted(range(2000), key=lambda i: (-score[i], i))[:10]
    assert sorted(got["doc_id"].to_pylist()) == sorted(best)
    assert visited[-1] < 1000
