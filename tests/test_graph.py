import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfuse.operators import graph as gr


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def ranks_of(res):
    return {r["id"]: r["rank"] for r in res.ranks.collect()}


def brute_pagerank(nodes, pairs, d=0.85, steps=10):
    idx = {n: i for i, n in enumerate(nodes)}
    n = len(nodes)
    out = np.zeros(n)
    for s, _ in pairs:
        out[idx[s]] += 1
    r = np.full(n, 1.0 / n)
    for _ in range(steps):
        inflow = np.zeros(n)
        for s, t in pairs:
            inflow[idx[t]] += r[idx[s]] / out[idx[s]]
        dangling = r[out == 0].sum()
        r = (1 - d) / n + d * (inflow + dangling / n)
    r = r / r.sum()
    return {k: r[i] for k, i in idx.items()}


def test_two_node_cycle(spark):
    r = ranks_of(gr.pagerank(edges_df(spark, [("a", "b"), ("b", "a")]), max_iter=20, tol=None))
    assert r["a"] == pytest.approx(0.5) and r["b"] == pytest.approx(0.5)


def test_all_dangling_uniform(spark):
    e = spark.createDataFrame([], "src string, dst string")
    r = ranks_of(gr.pagerank(e, ids_df(spark, ["a", "b", "c"]), max_iter=5, tol=None))
    assert r == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})


def test_star(spark):
    r = ranks_of(gr.pagerank(edges_df(spark, [("b", "a"), ("c", "a"), ("d", "a")]), max_iter=30, tol=None))
    assert r["a"] > r["b"] and r["b"] == pytest.approx(r["c"]) == pytest.approx(r["d"])
    assert sum(r.values()) == pytest.approx(1.0)


def test_parallel_edges_weight_inflow(spark):
    e = edges_df(spark, [("a", "b"), ("a", "b"), ("a", "c")])
    state = gr.pagerank_state(e).withColumn("rank", F.lit(1.0))
    got = {r["dst"]: r["inflow"] for r in gr.pagerank_inflow(state, e).collect()}
    assert got == pytest.approx({"b": 2 / 3, "c": 1 / 3})


def test_self_loop_keeps_mass(spark):
    res = gr.pagerank(edges_df(spark, [("a", "a"), ("a", "b")]), max_iter=10, tol=None, normalize=False)
    assert res.history[-1]["total"] == pytest.approx(1.0)


def test_reference_outside_corpus(spark):
    papers = spark.createDataFrame([("a", "t a"), ("b", "t b")], "id string, title string")
    e = edges_df(spark, [("a", "x"), ("b", "a")])
    res = gr.pagerank(e, papers.select("id"), max_iter=10, tol=None)
    r = ranks_of(res)
    assert set(r) == {"a", "b", "x"}
    titled = {row["id"] for row in gr.titled_ranks(res.ranks, papers).collect()}
    assert titled == {"a", "b"}


def test_null_and_empty_references(spark):
    p = spark.createDataFrame([("a", "t", None), ("b", "t", []), ("c", "t", ["a"])],
                              "id string, title string, references array<string>")
    e = gr.citation_edges(p)
    assert [(r.src, r.dst) for r in e.collect()] == [("c", "a")]
    nodes = {r.id for r in gr.graph_nodes(e, p.select("id")).collect()}
    assert nodes == {"a", "b", "c"}


def test_matches_brute_force_with_hot_source(spark):
    rng = np.random.default_rng(7)
    nodes = [f"n{i}" for i in range(40)]
    pairs = [(f"n{rng.integers(40)}", f"n{rng.integers(40)}") for _ in range(150)]
    pairs += [("n0", f"n{rng.integers(40)}") for _ in range(120)]  # hub: above edges/partitions
    res = gr.pagerank(edges_df(spark, pairs), ids_df(spark, nodes), max_iter=10, tol=None, checkpoint_interval=3)
    got = ranks_of(res)
    want = brute_pagerank(nodes, pairs)
    assert got == pytest.approx(want, abs=1e-12)


def test_convergence_stops_early(spark):
    res = gr.pagerank(edges_df(spark, [("a", "b"), ("b", "a")]), max_iter=50, tol=1e-4)
    assert res.converged and res.iterations < 50


def test_degree_statistics(spark):
    e = edges_df(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("d", "c")])
    hist = {r.in_degree: r.node_count for r in gr.in_degree_histogram(e).collect()}
    assert hist == {1: 1, 3: 1}
    avg = gr.avg_in_degree(e, gr.graph_nodes(e)).first()
    assert avg.in_edges == 4 and avg.cited_nodes == 2 and avg.avg_in_degree_cited == 2.0
    assert avg.avg_in_degree_all == 1.0
    # weighted histogram sum equals the edge count
    assert sum(k * v for k, v in hist.items()) == 4


def steps_with_messages(monkeypatch):
    """The ids that send in each step, from now on."""
    seen, inflow = [], gr.pagerank_inflow

    def spied(state, *edges):
        seen.append({r["id"] for r in state.where("out_degree > 0").select("id").collect()})
        return inflow(state, *edges)

    monkeypatch.setattr(gr, "pagerank_inflow", spied)
    return seen


def check_against_brute_force(spark, pairs, nodes, **kw):
    res = gr.pagerank(edges_df(spark, pairs), ids_df(spark, nodes), max_iter=10, tol=None, **kw)
    assert ranks_of(res) == pytest.approx(brute_pagerank(nodes, pairs), abs=1e-12)
    assert [h["total"] for h in res.history] == pytest.approx([1.0] * 10)
    return res


def layered_pairs():
    rng = np.random.default_rng(3)
    pairs = [(f"c{rng.integers(30)}", f"p{rng.integers(12)}") for _ in range(200)] + [("c0", f"p{rng.integers(12)}") for _ in range(150)]
    pairs += [(f"p{rng.integers(12)}", f"s{rng.integers(4)}") for _ in range(90)] + [("c3", "s1"), ("c3", "s1"), ("p99", "s0")]
    return pairs


def test_layered_graph_sends_before_the_steps(spark, monkeypatch):
    pairs = layered_pairs()
    seen = steps_with_messages(monkeypatch)
    res = check_against_brute_force(spark, pairs, sorted({x for p in pairs for x in p} | {"alone"}))
    assert seen == [] and res.iterations == 10


def test_steps_send_only_from_what_cycles_reach(spark, monkeypatch):
    """Layers before a cycle, behind it and beside it, with a hub in each part, a self-loop and parallel edges."""
    pairs = layered_pairs() + [("s0", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "x"), ("z", "tail"), ("tail", "end"), ("me", "me")]
    pairs += [("y", f"leaf{k % 9}") for k in range(160)] + [("c1", "y"), ("p3", "z"), ("p3", "end")]
    nodes = sorted({x for p in pairs for x in p})
    seen = steps_with_messages(monkeypatch)
    for every in (1, 3):
        check_against_brute_force(spark, pairs, nodes, checkpoint_interval=every)
    assert {frozenset(s) for s in seen[:10]} == {frozenset({"s0", "x", "y", "z", "tail", "me"})}  # s0's edge is too few for a layer
    monkeypatch.setattr(gr, "LAYERS", 1)
    check_against_brute_force(spark, pairs, nodes)


def test_history_and_stop_are_those_of_plain_steps(spark, monkeypatch):
    pairs = layered_pairs()
    for tol, normalize in ((None, True), (1e-2, False)):
        got = gr.pagerank(edges_df(spark, pairs), max_iter=6, tol=tol, normalize=normalize)
        with monkeypatch.context() as m:
            m.setattr(gr, "LAYERS", 0)
            want = gr.pagerank(edges_df(spark, pairs), max_iter=6, tol=tol, normalize=normalize)
        assert got.converged == want.converged and got.iterations == want.iterations
        for a, b in zip(got.history, want.history):
            assert a == pytest.approx(b, abs=1e-12)
        assert ranks_of(got) == pytest.approx(ranks_of(want), abs=1e-12)


def test_hubs_are_found_by_groups(spark, monkeypatch):
    e = edges_df(spark, [("a", f"n{k}") for k in range(9)] + [("b", "a")] * 4 + [("c", "a")] * 3)
    for groups in (1, 2, 1 << 16):
        monkeypatch.setattr(gr, "SOURCE_GROUPS", groups)
        assert sorted(r["src"] for r in gr.hub_sources(e, 3)) == ["a", "b"]
        assert gr.hub_sources(e, 9) == []


def test_tasks_of_a_run_follow_its_edges(spark, monkeypatch):
    monkeypatch.setattr(gr, "EDGES_A_TASK", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with gr.in_own_session(spark, {"edges": edges_df(spark, [("a", "b")] * 95)}) as tables:
        assert gr.shuffle_partitions(tables["edges"].sparkSession) == 10
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_degrees_of_both_ends(spark):
    e = edges_df(spark, [("a", "b"), ("a", "b"), ("b", "b"), (None, "a"), ("c", None)])
    got = {tuple(r) for r in gr.node_degrees(e, ids_df(spark, ["a", "z", "z", None])).collect()}
    assert got == {("a", 2, 0), ("b", 1, 3), ("z", 0, 0)}
