import math
import random

import pytest

from rankfuse.llm import topk


def brute(rows, every, k):
    known = []
    for n, (vec, v) in enumerate(rows):
        if vec is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((n, vec, [math.floor(1024 * x) for x in v]))
    out = []
    for n, vec, q in known:
        if vec % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, v)), c, m) for m, c, v in known if m != n)
            out += [(vec, r + 1, c, -s) for r, (s, c, _) in enumerate(hits[:k])]
    return sorted(out)


def some(n, seed, dims=6, spread=False):
    rnd = random.Random(seed)
    return [(k, [rnd.gauss(0, 0.3) * (rnd.choice([0.1, 1, 9]) if spread else 1) for _ in range(dims)]) for k in range(n)]


CASES = {
    "plain": some(300, 1),
    "lengths": some(300, 2, spread=True),
    "copies": some(60, 3) + [(k, [0.25] * 6) for k in range(100, 260)],
    "zeros": [(k, [0.0] * 4) for k in range(40)] + [(100, [1.0, -1.0, 0.5, 0.0])],
    "few": some(4, 5),
    "edges": some(50, 6) + [(None, [1.0] * 6), (60, None), (70, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (80, [math.nan] * 6), (90, [math.inf] * 6), (100, [0.5] * 3), (100, [0.5] * 3), (110, [])],
    "negative": [(k, [-1.0 - k % 7, 0.0]) for k in range(30)] + [(100, [1.0, 0.0])],
    "large": [(k, [3e5 * (k % 35 // 5), 3.0, -3e5]) for k in range(0, 60, 5)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("small", [False, True])
def test_against_all_products(spark, monkeypatch, name, small):
    if small:
        monkeypatch.setattr(topk, "BUCKET_ROWS", 20)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    df = spark.createDataFrame([(*r, 1) for r in CASES[name]], "vec_id long, embedding array<double>, bucket int")
    got = sorted(map(tuple, topk.digests(df, 10, 10).collect()))
    assert got == brute(CASES[name], 10, 10)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.digests(df, 10, 10).collect() == []


def test_pruning_prunes():
    import numpy as np

    rng = np.random.default_rng(0)
    v = (rng.normal(size=(5000, 32)) * 100).astype(np.int64)
    b = topk.Bucket(v, np.arange(5000), np.arange(5000))
    q = v[b.rows[7]] * 2
    size = math.sqrt(float((q.astype(float) ** 2).sum()))
    cosine = 0.95
    found = b.by_coordinates(q / size, cosine)
    near = np.flatnonzero((b.unit @ (q / size)) >= cosine)
    assert set(near) <= set(found) and len(found) < 2500
