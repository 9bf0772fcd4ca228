"""PageRank by residuals: only nodes whose change still matters send messages.

With dangling mass spread evenly, PageRank is a multiple of the solution ``y`` of
``y = 1/N + d * inflow(y)``: teleport and dangling share are the same for every node, so they are one
factor, which goes when the ranks are normalised. A state holds for each node its part ``p`` of ``y``
and its residual ``r = 1/N + d * inflow(p) - p``. A step adds the residuals of the *frontier* to their
ranks and sends them along their out-edges; all other nodes wait until theirs are worth sending.

The sum of all ``|r|`` bounds what is left: normalised ranks are within ``2 * sum|r| / (1 - d)`` of the
fixed point in L1. A run ends when that bound is below the tolerance, which therefore is one on
the *error*; ``graph.pagerank`` stops on the change of one step, behind which more error can stand.

A warm start takes ranks of another graph (a larger or an older one): the residual then is small
where the graphs agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import drop_path
from .graph import (PageRankResult, checkpoint_path, corpus_subsets_by_rank, handed_back, hub_split, in_own_session, known_edges,
                    pagerank_inflow, pagerank_state)

#: A node is in the frontier when its residual is above this share of the mean one. Those that wait hold
#: at most that share of all residuals, so each step still removes most of what one of all nodes would.
WAITS = 0.25


def pagerank_residual(edges: DataFrame, vertex_ids: DataFrame | None = None, damping: float = 0.85, tol: float = 1e-4,
                      start: DataFrame | None = None, max_iter: int = 200, waits: float = WAITS) -> PageRankResult:
    """Normalised PageRank within ``tol`` (L1) of the fixed point, unless ``max_iter`` steps don't get there.

    ``start(id, rank)``: ranks to begin with; they are scaled, ids outside the graph are ignored,
    nodes without one begin with their teleport share, repeated ids with their largest rank.
    ``waits`` (0 to below 1): see ``WAITS``; 0 sends every residual in every step. The history has for
    each step ``frontier`` (nodes that sent), ``messages`` (edges they sent along) and ``error`` (the
    bound after it). The edges aren't shuffled after they have been dealt by source, hubs are
    spread, each step is one job that writes the state, and one state is kept on the store.
    """
    if not 0 <= damping < 1 or tol <= 0 or not 0 <= waits < 1:
        raise ValueError("damping and waits must be in 0 to below 1, tol above 0")
    given = {"edges": known_edges(edges)}
    if vertex_ids is not None:
        given["ids"] = vertex_ids.select("id")
    if start is not None:
        given["start"] = start.where("id IS NOT NULL AND rank >= 0").groupBy("id").agg(F.max("rank").alias("rank"))
    with in_own_session(edges.sparkSession, given) as tables:
        res = _residual(tables["edges"], tables.get("ids"), tables.get("start"), damping, tol, max_iter, waits)
        return handed_back(edges.sparkSession, res)


def _residual(e: DataFrame, ids: DataFrame | None, start: DataFrame | None, damping: float, tol: float, max_iter: int,
              waits: float) -> PageRankResult:
    spark = e.sparkSession
    nodes = pagerank_state(e, ids)
    if start is not None:
        nodes = nodes.join(start, "id", "left")
    else:
        nodes = nodes.withColumn("rank", F.lit(None).cast("double"))
    obs = Observation("residual_init")
    dead = F.col("out_degree") == 0
    nodes = nodes.observe(
        obs, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("m"),
        F.coalesce(F.sum("rank"), F.lit(0.0)).alias("known"),
        F.coalesce(F.sum(F.when(dead, F.col("rank"))), F.lit(0.0)).alias("dangling"),
    ).checkpoint(eager=True)
    n, m, known, dangling = (obs.get[k] for k in ("n", "m", "known", "dangling"))
    stored = checkpoint_path(nodes)
    if n == 0:
        return PageRankResult(spark.createDataFrame([], "id string, rank double"), [], True, stored)
    cold, hot, hubs = hub_split(e)
    try:
        own = 1.0 / n
        if known > 0:
            scale = 1.0 / (known * (1.0 - damping + damping * dangling / known))
            begun = nodes.withColumn("rank", F.coalesce(F.col("rank") * scale, F.lit(own)))
            came = _received(begun, pagerank_inflow(begun, cold, hot, hubs))
            state = came.select("id", "out_degree", "rank", (F.lit(own) + damping * F.col("inflow") - F.col("rank")).alias("residual"))
            obs = Observation("residual_start")
            left = F.sum(F.abs("residual")).alias("left")
            state = state.observe(obs, left, F.sum("rank").alias("total")).checkpoint(eager=True)
            drop_path(spark, stored)
            stored = checkpoint_path(state)
            left, total = obs.get["left"], obs.get["total"]
        else:
            state = nodes.select("id", "out_degree", F.lit(0.0).alias("rank"), F.lit(own).alias("residual"))
            left, total = 1.0, 0.0
        history: list = []
        while (error := 2.0 * left / (1.0 - damping)) >= tol and len(history) < max_iter:
            sends = F.abs("residual") > waits * left / n
            sent = state.where(sends).select("id", "out_degree", F.col("residual").alias("rank"))
            came = _received(state, pagerank_inflow(sent, cold, hot, hubs))
            kept = F.when(sends, 0.0).otherwise(F.col("residual"))
            step = came.select(
                "id", "out_degree", F.when(sends, F.col("rank") + F.col("residual")).otherwise(F.col("rank")).alias("rank"),
                (kept + damping * F.col("inflow")).alias("residual"), sends.alias("sent"))
            obs = Observation(f"residual_{len(history) + 1}")
            state = step.observe(
                obs, F.sum(F.abs("residual")).alias("left"), F.sum("rank").alias("total"), F.count_if("sent").alias("frontier"),
                F.coalesce(F.sum(F.when(F.col("sent"), F.col("out_degree"))), F.lit(0)).alias("messages"),
            ).select("id", "out_degree", "rank", "residual").checkpoint(eager=True)
            drop_path(spark, stored)
            stored = checkpoint_path(state)
            seen = obs.get
            left, total = float(seen["left"]), float(seen["total"])
            history.append({"iteration": len(history) + 1, "error": 2.0 * left / (1.0 - damping), "total": total,
                            "frontier": int(seen["frontier"]), "messages": int(seen["messages"])})
    finally:
        cold.unpersist()
        if hot is not None:
            hot.unpersist()
    share = F.col("rank") / F.lit(total) if total > 0 else F.lit(own)
    return PageRankResult(state.select("id", share.alias("rank")), history, error < tol, stored)


def _received(state: DataFrame, inflow: DataFrame) -> DataFrame:
    """``state`` with what each node received (0.0 if nothing); the state keeps its partitioning."""
    return state.join(inflow, state["id"] == inflow["dst"], "left").withColumn("inflow", F.coalesce("inflow", F.lit(0.0))).drop("dst")


def messages_by_step(res: PageRankResult, spark) -> DataFrame:
    """``(iteration, frontier, messages, error)`` of a run by residuals."""
    rows = [(h["iteration"], h["frontier"], h["messages"], h["error"]) for h in res.history]
    return spark.createDataFrame(rows, "iteration long, frontier long, messages long, error double")


def subset_ranks(papers: DataFrame, edges: DataFrame, ranks: DataFrame, sizes: list[int], damping: float = 0.85,
                 tol: float = 1e-4) -> dict[int, PageRankResult]:
    """PageRank *within* each of the nested subsets of the best-ranked papers (corpus-size experiments).

    The largest subset starts from the given ranks, each smaller one from the next larger one's."""
    subsets = corpus_subsets_by_rank(papers, edges, ranks, sizes)
    out: dict[int, PageRankResult] = {}
    known = ranks
    for n in sorted(set(sizes), reverse=True):
        sub, among = subsets[n]
        out[n] = pagerank_residual(among, sub.select("id"), damping, tol, start=known)
        known = out[n].ranks
    return {n: out[n] for n in sizes}
