import hashlib

import duckdb
import numpy as np
import pytest

from rankfuse.llm import clustering as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def brute(rows, k, rounds, size=64):
    kept = []
    for vec_id, e, *_ in rows:
        if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]))
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cent = [v for _, v in sorted(kept, key=key)[:k]]
    for t in range(rounds + 1):
        dist = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cent] for _, v in kept]
        own = [d.index(min(d)) for d in dist]
        if t < rounds:
            for j in range(len(cent)):
                mine = [v for (_, v), a in zip(kept, own) if a == j]
                if mine:
                    cent[j] = [sum(x) // len(mine) for x in zip(*mine)]
    per = [sum(d[a] for d, a in zip(dist, own) if a == j) for j in range(len(cent))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return [(r[0], a, d[a], per[a], sum(per), sha[a]) for r, a, d in zip(kept, own, dist)]


def embeddings(n=300, seed=1):
    rng = np.random.default_rng(seed)
    mid = rng.normal(0, 0.2, (6, 64))
    rows = [(k, (mid[k % 6] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist(), k, "x", 1) for k in range(n)]
    rows += [(7, rows[7][1], 7, "x", 1), (7, rows[7][1], 7, "x", 1), (None, rows[9][1], None, None, None), (900, None, 1, "x", 1), (901, [], 1, "x", 1),
             (902, [1.0] * 63, 1, "x", 1), (903, [float("nan")] * 64, 1, "x", 1), (904, [None] * 64, 1, "x", 1), (905, [float("inf")] + [0.0] * 63, 1, "x", 1),
             (906, [0.0] * 64, 1, "x", 1), (-5, [-1.0] * 64, 1, "x", 1)]
    return rows


@pytest.mark.parametrize("k, rounds, seed", [(8, 5, 1), (40, 5, 2), (1, 2, 3), (500, 1, 4)])
def test_equals_brute_force(spark, k, rounds, seed):
    rows = embeddings(150, seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, C.digests(df, k, rounds).collect()), key=str)
    assert got == sorted(brute(rows, k, rounds), key=str)


def test_empty_and_unusable_tables(spark):
    df = spark.createDataFrame([(1, None, 1, "x", 1), (2, [1.0], 1, "x", 1)], SCHEMA)
    want = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for d in (df, df.limit(0)):
        out = C.digests(d, 40, 5)
        assert out.columns == want and out.collect() == []


def test_ties_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([(k, [float(k % 2)] + [0.0] * 63, 0, "", 0) for k in range(2)] + [(2, [0.5] + [0.0] * 63, 0, "", 0)], SCHEMA)
    got = {r.vec_id: r.cluster for r in C.digests(df, 2, 0).collect()}
    starts = sorted(range(3), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:2]
    if set(starts) == {0, 1}:
        assert got[2] == 0
    assert got == {r[0]: r[1] for r in brute([(0, [0.0] * 64), (1, [1.0] + [0.0] * 63), (2, [0.5] + [0.0] * 63)], 2, 0)}


def test_loosening_covers_all_members_and_is_less_than_the_drift():
    rng = np.random.default_rng(0)
    less = 0
    for _ in range(60):
        old = rng.integers(-300, 300, (7, 5))
        new = old + rng.integers(-40, 40, old.shape)
        radius = rng.uniform(1, 200, 7)
        loose = C.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(7):
            x = rng.normal(size=(4000, 5))
            x = old[i] + x / np.linalg.norm(x, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (4000, 1)) ** 0.2
            others = [j for j in range(7) if j != i]
            nearer = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            assert nearer <= loose[i] + 1e-9
            assert loose[i] <= drift[others].max() * (1 + 1e-6)
            less += loose[i] < 0.9 * drift[others].max()
    assert less > 50


def test_bounds_settle_vectors_and_large_components(spark):
    rng = np.random.default_rng(2)
    mid = rng.normal(0, 1, (8, 64))
    rows = [(k, [int(x) for x in 256 * (mid[k % 8] + rng.normal(0, 0.1, 64))]) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = C.cluster(df, C.F.col("vec_id"), 8, 4)
    assert got.work[0] == {"settled": 0, "scanned": 800}
    assert got.work[-1]["scanned"] < 200 and sum(got.work[-1].values()) == 800
    big = np.array([[1 << 26, -(1 << 26)], [5, 7]])
    assert C.squared(big, big).tolist() == [[0, (big[0] - big[1]) @ (big[0] - big[1])], [(big[0] - big[1]) @ (big[0] - big[1]), 0]]
    with pytest.raises(ValueError, match="fit a long"):
        C.cluster(spark.createDataFrame([(1, [1 << 40])], "vec_id long, v array<long>"), C.F.col("vec_id"), 1, 1)


def test_sql_on_edge_rows(spark, tmp_path):
    rows = embeddings(120, 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    got = sorted(con.sql(C.oracle(40, 5)).fetchall(), key=str)
    assert got == sorted(brute(rows, 40, 5), key=str)
