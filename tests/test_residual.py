"""PageRank by residuals against plain iteration to the fixed point."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfuse.operators import graph as gr
from rankfuse.operators import residual as rs

D = 0.4  # few steps


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def ranks_of(res):
    return {r["id"]: r["rank"] for r in res.ranks.collect()}


def fixed_point(nodes, pairs, d=D):
    """Plain iteration, long enough."""
    at = {n: i for i, n in enumerate(nodes)}
    out = np.bincount([at[s] for s, _ in pairs], minlength=len(nodes))
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(100):
        new = np.full(len(nodes), (1 - d + d * r[out == 0].sum()) / len(nodes))
        for s, t in pairs:
            new[at[t]] += d * r[at[s]] / out[at[s]]
        r = new
    return dict(zip(nodes, r))


def made(seed=3, nodes=60, edges=300):
    rng = np.random.default_rng(seed)
    names = [f"n{i}" for i in range(nodes)]
    pairs = [(f"n{rng.integers(nodes)}", f"n{int(nodes * rng.random() ** 2)}") for _ in range(edges)]
    pairs += [("n0", f"n{rng.integers(nodes)}") for _ in range(edges // 2)]  # a hub
    pairs += [("n1", "n1"), ("n2", "n3"), ("n2", "n3")]  # a loop, a parallel edge
    return names + ["alone"], [p for p in pairs if p[0] != "n7"]  # n7 and alone are dangling


def distance(got, want):
    assert set(got) == set(want)
    return sum(abs(got[k] - want[k]) for k in want)


@pytest.mark.parametrize("tol,waits", [(1e-4, 0.25), (1e-3, 0.0)])
def test_within_tolerance_of_the_fixed_point(spark, tol, waits):
    nodes, pairs = made()
    res = rs.pagerank_residual(edges_df(spark, pairs), ids_df(spark, nodes), D, tol=tol, waits=waits)
    assert res.converged and res.history[-1]["error"] < tol
    got = ranks_of(res)
    assert sum(got.values()) == pytest.approx(1.0)
    assert distance(got, fixed_point(nodes, pairs)) < tol


def test_messages_fall(spark):
    # chains of 20 nodes into a sink: of each only the front still has something to send
    pairs = [(f"c{c}-{k}", f"c{c}-{k + 1}") for c in range(5) for k in range(20)]
    res = rs.pagerank_residual(edges_df(spark, pairs), tol=1e-4)
    sent = [h["messages"] for h in res.history]
    assert sent[0] == len(pairs) and all(a >= b for a, b in zip(sent, sent[1:])) and sent[-1] < len(pairs) / 4
    assert sum(sent) < 0.7 * len(pairs) * len(sent)
    rows = rs.messages_by_step(res, spark).orderBy("iteration").collect()
    assert [r.messages for r in rows] == sent and [r.frontier for r in rows][0] == 105


def test_warm_start(spark):
    nodes, pairs = made(seed=5)
    e, ids = edges_df(spark, pairs), ids_df(spark, nodes)
    cold = rs.pagerank_residual(e, ids, D, tol=1e-4)
    again = rs.pagerank_residual(e, ids, D, tol=1e-3, start=cold.ranks)
    assert again.converged and again.iterations == 0
    assert distance(ranks_of(again), ranks_of(cold)) < 1e-3
    # one edge more, an unknown id, a repeated one and a null in the start
    more = [*pairs, ("alone", "n4")]
    odd = cold.ranks.union(spark.createDataFrame([("elsewhere", 0.5), ("n4", 0.0), (None, 1.0)], "id string, rank double"))
    warm = rs.pagerank_residual(edges_df(spark, more), ids, D, tol=1e-3, start=odd.where("id <> 'n9'"))
    fresh = rs.pagerank_residual(edges_df(spark, more), ids, D, tol=1e-3)
    assert distance(ranks_of(warm), fixed_point(nodes, more)) < 1e-3
    assert sum(h["messages"] for h in warm.history) < sum(h["messages"] for h in fresh.history)


def test_subsets_start_from_the_larger_ones(spark):
    nodes, pairs = made(seed=8)
    papers = spark.createDataFrame([(n, f"title {n}") for n in nodes], "id string, title string")
    e = edges_df(spark, pairs)
    ranks = rs.pagerank_residual(e, ids_df(spark, nodes), D, tol=1e-3).ranks
    got = rs.subset_ranks(papers, e, ranks, [15, 40], D, tol=1e-3)
    assert list(got) == [15, 40]
    for n, res in got.items():
        kept = {r.id for r in gr.top_ranked(ranks, n).collect()}
        among = [(a, b) for a, b in pairs if a in kept and b in kept]
        assert distance(ranks_of(res), fixed_point(sorted(kept), among)) < 1e-3


def test_edges_of_the_graph(spark):
    none = edges_df(spark, [("x", "y")]).where(F.lit(False))
    assert ranks_of(rs.pagerank_residual(none)) == {}
    assert ranks_of(rs.pagerank_residual(none, ids_df(spark, ["a", "b"]))) == pytest.approx({"a": 0.5, "b": 0.5})
    null = edges_df(spark, [("a", "b"), ("b", "a"), (None, "a"), ("a", None)])
    assert ranks_of(rs.pagerank_residual(null, tol=1e-2, damping=D)) == pytest.approx({"a": 0.5, "b": 0.5})
    stopped = rs.pagerank_residual(edges_df(spark, made()[1]), tol=1e-12, max_iter=2)
    assert not stopped.converged and stopped.iterations == 2
    for wrong in ({"tol": 0}, {"damping": 1.0}, {"waits": 1.0}):
        with pytest.raises(ValueError):
            rs.pagerank_residual(null, **wrong)


def test_leaves_no_state_and_no_setting(spark):
    root = spark.sparkContext.getCheckpointDir().replace("file:", "", 1)
    held = lambda: {p for p in os.listdir(root) if p.startswith("rdd-")}
    before, adaptive = held(), spark.conf.get("spark.sql.adaptive.enabled")
    rs.pagerank_residual(edges_df(spark, made()[1]), damping=D, tol=1e-2)
    assert held() == before and spark.conf.get("spark.sql.adaptive.enabled") == adaptive
