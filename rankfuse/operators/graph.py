"""Citation-graph operators: edges, nodes, degrees, PageRank, rank reports, subgraphs."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import md5_key, truncate_label
from ..session import child_session, drop_path, ensure_checkpoint_dir, shuffle_partitions
from ..sources.io import scratch, stage
from .membership import bloom_words, maybe_members
from .ordering import significant

#: Layers of sources that send ahead of PageRank's steps, and the share of the edges left (one in so many) that a layer
#: must hold, so that its pass spares the steps more than it costs.
LAYERS, LAYER_SHARE = 6, 10
#: Groups of sources whose edges are counted together in the search for hubs.
SOURCE_GROUPS = 1 << 16
#: Edges to a task in a PageRank run.
EDGES_A_TASK = 2_000_000


def rank_key(col: str | Column = "rank") -> Column:
    """Order key of a rank, relative to its own magnitude (see ``ordering.significant``)."""
    return significant(F.col(col) if isinstance(col, str) else col)


# --- edges, nodes, degrees ------------------------------------------------------------------

def citation_edges(papers: DataFrame) -> DataFrame:
    """One edge per reference entry (parallel edges kept; null/empty lists give none)."""
    return papers.select(F.col("id").alias("src"), F.explode("references").alias("dst")).where(
        F.col("dst").isNotNull()
    )


def graph_nodes(edges: DataFrame, vertex_ids: DataFrame | None = None) -> DataFrame:
    """Distinct ids of the corpus plus every id an edge touches (cited ids outside the corpus too)."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    if vertex_ids is not None:
        ids = vertex_ids.select("id").unionByName(ids)
    return ids.where(F.col("id").isNotNull()).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("dst").isNotNull()).groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


def in_degree_histogram(edges: DataFrame) -> DataFrame:
    """``(in_degree, node_count)``: how many cited nodes have each in-degree."""
    return in_degree(edges).groupBy("in_degree").agg(F.count(F.lit(1)).alias("node_count"))


def avg_in_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: in-edges, cited nodes, mean in-degree over cited nodes (0.0 if none) and,
    when ``nodes`` is given, the mean over all nodes."""
    deg = in_degree(edges)
    out = deg.agg(
        F.coalesce(F.sum("in_degree"), F.lit(0)).cast("long").alias("in_edges"),
        F.count(F.lit(1)).alias("cited_nodes"),
    ).withColumn(
        "avg_in_degree_cited",
        F.when(F.col("cited_nodes") > 0, F.col("in_edges") / F.col("cited_nodes")).otherwise(F.lit(0.0)),
    )
    if nodes is None:
        return out
    from ..functions.stats import combine_rows

    total = nodes.agg(F.count(F.lit(1)).alias("all_nodes"))
    return combine_rows(out, total).withColumn(
        "avg_in_degree_all",
        F.when(F.col("all_nodes") > 0, F.col("in_edges") / F.col("all_nodes")).otherwise(F.lit(0.0)),
    )


def sources(edges: DataFrame) -> DataFrame:
    """Ids with out-edges, once each: pre-aggregated, so a hub's edges don't meet in one task."""
    return edges.where(F.col("src").isNotNull()).select(F.col("src").alias("id")).distinct()


def dangling_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without out-edges."""
    return nodes.join(sources(edges), "id", "left_anti")


def dangling_mass(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """Total rank held by nodes without out-edges (0.0 when none)."""
    dead = ranks.join(sources(edges), "id", "left_anti")
    return dead.agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("dangling_mass"))


# --- PageRank ---------------------------------------------------------------------------------

@dataclass
class PageRankResult:
    ranks: DataFrame
    history: list = field(default_factory=list)  # dicts: iteration, error, total, dangling
    converged: bool = False
    stored: str | None = None  # the checkpoint that holds the last state

    @property
    def iterations(self) -> int:
        return len(self.history)

    def history_df(self, spark) -> DataFrame:
        rows = [(h["iteration"], h["error"], h["total"]) for h in self.history]
        return spark.createDataFrame(rows, "iteration long, error double, total double")


def checkpoint_path(df: DataFrame) -> str | None:
    """The folder that a just checkpointed frame is read from."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def pagerank_inflow(state: DataFrame, cold_edges: DataFrame, hot_edges: DataFrame | None = None,
                    hot_src: DataFrame | None = None) -> DataFrame:
    """Rank each node receives: sum over in-edges of rank(src) / out_degree(src).

    ``cold_edges`` are joined on ``src`` by shuffle; ``hot_edges`` (sources above the hot
    threshold, < one partition's worth each) meet a broadcast of their few source shares, so a
    source holding a large share of all edges is spread over every task instead of one.
    """
    share = state.where(F.col("out_degree") > 0).select(
        F.col("id").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share")
    )
    msgs = _along_edges(share, cold_edges, hot_edges, hot_src)
    return msgs.groupBy("dst").agg(F.sum("share").alias("inflow"))


def _along_edges(sent: DataFrame, cold_edges: DataFrame, hot_edges: DataFrame | None, hot_src: DataFrame | None) -> DataFrame:
    """What ``sent(src, ...)`` holds for a source, once for each of its edges: ``(dst, ...)``."""
    values = [c for c in sent.columns if c != "src"]
    msgs = cold_edges.join(sent, "src").select("dst", *values)
    if hot_edges is not None:
        hot_sent = sent.join(F.broadcast(hot_src), "src", "left_semi")  # < partitions rows
        msgs = msgs.unionByName(hot_edges.join(F.broadcast(hot_sent), "src").select("dst", *values))
    return msgs


def hub_sources(edges: DataFrame, threshold: int) -> list:
    """Sources with more than ``threshold`` out-edges. Edges are counted by groups of sources first, so that only
    the sources of groups above the threshold are counted one by one."""
    group = F.pmod(F.xxhash64("src"), F.lit(SOURCE_GROUPS))
    counts = edges.groupBy(group.alias("of")).agg(F.count(F.lit(1)).alias("edges"))
    full = [r["of"] for r in counts.where(F.col("edges") > threshold).collect()]
    if not full:
        return []
    return out_degree(edges.where(group.isin(full))).where(F.col("out_degree") > threshold).select("src").collect()


def hub_split(e: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The edges by source, persisted: ``cold`` ones hash-partitioned and sorted by source, ``hot`` ones (of
    sources with more than a partition's share of all edges) spread by both ends, and the hot sources,
    fewer than there are partitions by construction. ``hot`` and its sources are None if there are none."""
    spark = e.sparkSession
    parts = shuffle_partitions(spark)
    hubs = hub_sources(e, max(1, e.count() // max(parts, 1)))
    cold, hot, hot_src = e, None, None
    if hubs:
        hot_src = spark.createDataFrame(hubs, "src string")
        cold = e.join(F.broadcast(hot_src), "src", "left_anti")
        hot = e.join(F.broadcast(hot_src), "src", "left_semi").repartition(parts, "src", "dst")
        hot = hot.persist(StorageLevel.MEMORY_AND_DISK)
    cold = cold.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    return cold, hot, hot_src


def pagerank_step(state: DataFrame, inflow: DataFrame, n_nodes: int, dangling: float, damping: float = 0.85,
                  fed: Column | None = None) -> DataFrame:
    """One step: ``(1-d)/N + d * (inflow + dangling/N)`` for every node; keeps the old rank as ``prev``.
    ``fed``, over the state's columns, is what a node receives besides ``inflow``."""
    j = state.join(inflow, state["id"] == inflow["dst"], "left")
    came = F.coalesce(F.col("inflow"), F.lit(0.0))
    new_rank = _new_rank(came if fed is None else came + fed, n_nodes, dangling, damping)
    return j.select(*[state[c] for c in state.columns if c != "rank"], new_rank.alias("rank"), state["rank"].alias("prev"))


def _new_rank(came: Column, n_nodes: int, dangling: float, damping: float) -> Column:
    return F.lit((1.0 - damping) / n_nodes) + F.lit(damping) * (came + F.lit(dangling / n_nodes))


def node_degrees(edges: DataFrame, vertex_ids: DataFrame | None = None) -> DataFrame:
    """``(id, out_degree, in_degree)`` for every node, counted in one shuffle of both ends."""
    e = known_edges(edges)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = e.select(F.col("src").alias("id"), one.alias("o"), none.alias("i")).unionByName(
        e.select(F.col("dst").alias("id"), none.alias("o"), one.alias("i")))
    if vertex_ids is not None:
        ids = vertex_ids.select("id").where(F.col("id").isNotNull())
        ends = ends.unionByName(ids.select("id", none.alias("o"), none.alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank_state(edges: DataFrame, vertex_ids: DataFrame | None = None) -> DataFrame:
    """``(id, out_degree)`` for every node (0 for dangling nodes)."""
    return node_degrees(edges, vertex_ids).select("id", "out_degree")


@dataclass
class Layers:
    """A graph whose first layers are settled: ``state(id, out_degree, settled, fed_0, ...)``, stored, and the edges of
    the sources that are not (``live`` in number). Lost blocks of these are computed from it, so it stays to the end."""

    state: DataFrame
    stored: str | None
    depth: int
    live: int
    cold: DataFrame
    hot: DataFrame | None
    hot_src: DataFrame | None

    def fed(self, weights: list[float]) -> Column:
        """What a node receives from settled ones when these rank ``sum(weights[k] * X_k)``."""
        return reduce(Column.__add__, [F.lit(w) * F.col(f"fed_{k}") for k, w in enumerate(weights)])


def settle_layers(state: DataFrame, n_edges: int, ready: int, cold: DataFrame, hot: DataFrame | None,
                  hot_src: DataFrame | None, most: int) -> Layers:
    """Send once, ahead of the steps, what sources pass on whose own rank no message of a step can change.

    A node without in-edges has the same rank as any other such node in every step, a number ``c_0``.
    With ``X_0 = 1`` and ``X_k+1(v)`` the sum of ``X_k(u) / out_degree(u)`` over v's in-edges, a node fed by such nodes
    alone ranks ``c_0 + c_1 * X_1``, one fed by these ``c_0 + c_1 * X_1 + c_2 * X_2``: a step changes the numbers
    ``c_k``, never the sums. So each layer sends its ``X_k`` once, every node keeps ``fed_k``, what it got of each from all
    settled sources (for a settled node that is ``X_k+1``), and only the other edges carry messages in the steps.

    ``state(id, out_degree, in_degree)`` is a checkpoint, ``ready`` the edges of its nodes without in-edges. A layer is
    sent while it holds a tenth of the edges left, ``most`` or ``LAYERS`` times at most. Parallel edges and
    self-loops count like others (a self-loop never settles).
    """
    stored = checkpoint_path(state)
    state = state.select("id", "out_degree", F.lit(False).alias("settled"), F.col("in_degree").alias("waits"))
    depth, live = 0, n_edges
    while ready and ready * LAYER_SHARE >= live and depth < min(LAYERS, most):
        now = ~F.col("settled") & (F.col("waits") == 0)
        xs = [F.lit(1.0), *[F.col(f"fed_{k}") for k in range(depth)]]
        sent = state.where(now & (F.col("out_degree") > 0)).select(
            F.col("id").alias("src"), *[(x / F.col("out_degree")).alias(f"x_{k}") for k, x in enumerate(xs)])
        got = _along_edges(sent, cold, hot, hot_src).groupBy("dst").agg(
            F.count(F.lit(1)).alias("got"), *[F.sum(f"x_{k}").alias(f"x_{k}") for k in range(depth + 1)])
        zero = F.lit(0.0)
        fed = [(F.coalesce(F.col(f"x_{k}"), zero) + (F.col(f"fed_{k}") if k < depth else zero)).alias(f"fed_{k}") for k in range(depth + 1)]
        obs = Observation(f"pagerank_layer_{depth}")
        waiting = F.when(~F.col("settled"), F.col("out_degree"))
        state = state.join(got, state["id"] == got["dst"], "left").select(
            "id", "out_degree", (F.col("settled") | now).alias("settled"),
            (F.col("waits") - F.coalesce("got", F.lit(0))).alias("waits"), *fed,
        ).observe(
            obs,
            F.coalesce(F.sum(waiting), F.lit(0)).alias("live"),
            F.coalesce(F.sum(F.when(F.col("waits") == 0, waiting)), F.lit(0)).alias("ready"),
        ).checkpoint(eager=True)
        drop_path(state.sparkSession, stored)
        stored = checkpoint_path(state)
        live, ready, depth = int(obs.get["live"]), int(obs.get["ready"]), depth + 1
    if depth and live:
        ids = state.where(~F.col("settled") & (F.col("out_degree") > 0)).select(F.col("id").alias("src"))
        given = cold, hot
        cold = cold.join(ids, "src", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
        cold.count()
        if hot is not None:
            hot_src = hot_src.join(ids, "src", "left_semi")
            hot = hot.join(F.broadcast(hot_src), "src", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
            hot.count()
        for edges in given:
            if edges is not None:
                edges.unpersist()
    return Layers(state.drop("waits"), stored, depth, live, cold, hot, hot_src)


def pagerank(edges: DataFrame, vertex_ids: DataFrame | None = None, damping: float = 0.85,
             max_iter: int = 50, tol: float | None = 1e-4, normalize: bool = True,
             checkpoint_interval: int = 1) -> PageRankResult:
    """PageRank with uniform start 1/N, dangling mass spread evenly, stop when L1 change < tol.

    Sources that no message of a step can reach (none leads to them but from such ones) send once, before the
    steps (``settle_layers``); where all sources are such, the steps shuffle and write nothing.
    Per step exactly one job, which also observes the step's L1 error, total and dangling mass.
    Every ``checkpoint_interval`` steps (1 to 3, else ValueError) the state is checkpointed
    reliably into the session's checkpoint directory, and the one before it is deleted there: a
    run keeps one state on the store, and the one it began its steps with. Steps in between are persisted; each step reads the
    previous state twice, so longer persisted chains inflate plan descriptions exponentially,
    and a lost executor replays up to that many steps. The result is a table (``io.release``
    removes it). Edges are
    persisted once, hash-partitioned by source; sources whose out-degree exceeds
    (edges / partitions) are split off and spread by (src, dst).

    The steps are planned without adaptive execution, in a session of their own (the caller's
    settings stay): only then does a checkpointed state keep its partitioning by id, so that a step
    shuffles nothing but the partial sums of its messages. Hubs, the skew that adaptive plans
    would split, are split here already. Tasks get no more than ``EDGES_A_TASK`` edges (but for
    parallel ones of a hub) however few partitions the caller's session has. Edges and ids are handed
    over as tables, which go at the end.
    """
    if not 1 <= checkpoint_interval <= 3:
        raise ValueError(f"checkpoint_interval must be 1, 2 or 3, not {checkpoint_interval}")
    given = {"edges": known_edges(edges)}
    if vertex_ids is not None:
        given["ids"] = vertex_ids.select("id")
    with in_own_session(edges.sparkSession, given) as tables:
        res = _pagerank(tables["edges"], tables.get("ids"), damping, max_iter, tol, normalize, checkpoint_interval)
        return handed_back(edges.sparkSession, res)


def known_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())


@contextmanager
def in_own_session(spark, given: dict[str, DataFrame]):
    """The frames as tables of a session without adaptive execution; the tables go at the end."""
    ensure_checkpoint_dir(spark)
    own = child_session(spark, {"spark.sql.adaptive.enabled": "false"})
    tables: dict[str, DataFrame] = {}
    try:
        for name, df in given.items():
            tables[name] = stage(df, f"pagerank-{name}")
        parts = -(-tables["edges"].count() // EDGES_A_TASK)
        own.conf.set("spark.sql.shuffle.partitions", str(max(shuffle_partitions(spark), parts)))
        yield {name: own.read.schema(t.schema).parquet(t.staged_at) for name, t in tables.items()}
    finally:
        for t in tables.values():
            drop_path(spark, t.staged_at)


def handed_back(spark, res: PageRankResult) -> PageRankResult:
    """``res`` with its ranks as a table of the caller's session, in place of the last checkpoint."""
    path = scratch(spark, "ranks")
    res.ranks.write.parquet(path)
    res.ranks = spark.read.schema(res.ranks.schema).parquet(path)
    drop_path(spark, res.stored)
    return res


def _pagerank(e: DataFrame, vertex_ids: DataFrame | None, damping: float, max_iter: int, tol: float | None,
              normalize: bool, checkpoint_interval: int) -> PageRankResult:
    spark = e.sparkSession
    cold, hot, hot_src = hub_split(e)
    layers = None
    try:
        obs0 = Observation("pagerank_init")
        state0 = node_degrees(cold if hot is None else cold.unionByName(hot), vertex_ids).observe(
            obs0,
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("out_degree"), F.lit(0)).alias("m"),
            F.count_if(F.col("out_degree") == 0).alias("dangling"),
            F.coalesce(F.sum(F.when(F.col("in_degree") == 0, F.col("out_degree"))), F.lit(0)).alias("ready"),
        ).checkpoint(eager=True)
        n_nodes, n_edges, n_dangling, ready = (int(obs0.get[k]) for k in ("n", "m", "dangling", "ready"))
        if n_nodes == 0:
            return PageRankResult(spark.createDataFrame([], "id string, rank double"), [], True, checkpoint_path(state0))
        layers = settle_layers(state0, n_edges, ready, cold, hot, hot_src, max_iter)
        run = _steps if layers.live or not layers.depth else _steps_of_settled
        res = run(layers, n_nodes, n_dangling * (1.0 / n_nodes), damping, max_iter, tol, normalize, checkpoint_interval)
        if res.stored != layers.stored:
            drop_path(spark, layers.stored)
        return res
    finally:
        for edges in (cold, hot, *((layers.cold, layers.hot) if layers else ())):
            if edges is not None:
                edges.unpersist()


def _seen_in_step() -> list[Column]:
    return [
        F.sum(F.abs(F.col("rank") - F.col("prev"))).alias("error"),
        F.sum("rank").alias("total"),
        F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling"),
    ]


def _next_weights(weights: list[float], n_nodes: int, dangling: float, damping: float) -> list[float]:
    """The numbers ``c_k`` (see ``settle_layers``) after a step from those before it."""
    return [(1.0 - damping) / n_nodes + damping * (dangling / n_nodes), *[damping * w for w in weights]][: len(weights)]


def _steps_of_settled(layers: Layers, n_nodes: int, dangling: float, damping: float, max_iter: int, tol: float | None,
                      normalize: bool, checkpoint_interval: int) -> PageRankResult:
    """The steps when all sources are settled: a rank is a sum over columns that no step changes, so a step is
    one aggregation over the stored state."""
    weights = [1.0 / n_nodes] + [0.0] * (layers.depth - 1)
    rank, total, history, converged = F.lit(1.0 / n_nodes), 1.0, [], False
    for i in range(max_iter):
        new_rank = _new_rank(layers.fed(weights), n_nodes, dangling, damping)
        m = layers.state.select("out_degree", new_rank.alias("rank"), rank.alias("prev")).agg(*_seen_in_step()).first()
        weights = _next_weights(weights, n_nodes, dangling, damping)
        rank, total, dangling = new_rank, float(m["total"]), float(m["dangling"])
        history.append({"iteration": i + 1, "error": float(m["error"]), "total": total, "dangling": dangling})
        if tol is not None and m["error"] < tol:
            converged = True
            break
    ranks = layers.state.select("id", (rank / F.lit(total) if normalize else rank).alias("rank"))
    return PageRankResult(ranks, history, converged, layers.stored)


def _steps(layers: Layers, n_nodes: int, dangling: float, damping: float, max_iter: int, tol: float | None,
           normalize: bool, checkpoint_interval: int) -> PageRankResult:
    state = layers.state.withColumn("rank", F.lit(1.0 / n_nodes))
    weights = [1.0 / n_nodes] + [0.0] * (layers.depth - 1) if layers.depth else []
    history: list = []
    converged = False
    total = 1.0
    held = None  # persisted state of the previous step
    stored = layers.stored  # what the store holds of the run
    for i in range(max_iter):
        inflow = pagerank_inflow(state.where(~F.col("settled")), layers.cold, layers.hot, layers.hot_src)
        step = pagerank_step(state, inflow, n_nodes, dangling, damping, layers.fed(weights) if weights else None)
        weights = _next_weights(weights, n_nodes, dangling, damping)
        obs = Observation(f"pagerank_{i + 1}")
        observed = step.observe(obs, *_seen_in_step()).drop("prev")
        last = i + 1 == max_iter
        if last or (i + 1) % checkpoint_interval == 0:
            new_state = observed.checkpoint(eager=True)
            if stored != layers.stored:
                drop_path(state.sparkSession, stored)
            stored = checkpoint_path(new_state)
        else:
            new_state = observed.persist(StorageLevel.MEMORY_AND_DISK)
            new_state.count()
        m = obs.get
        if held is not None:
            held.unpersist()
        held = None if new_state.is_cached is False else new_state
        state = new_state
        total, dangling = float(m["total"]), float(m["dangling"])
        history.append({"iteration": i + 1, "error": float(m["error"]), "total": total, "dangling": dangling})
        if tol is not None and m["error"] < tol:
            converged = True
            if held is not None:  # converged on a persisted step: make the result durable
                state = state.checkpoint(eager=True)
                if stored != layers.stored:
                    drop_path(state.sparkSession, stored)
                stored = checkpoint_path(state)
                held.unpersist()
            break
    rank = F.col("rank") / F.lit(total) if normalize else F.col("rank")
    return PageRankResult(state.select("id", rank.alias("rank")), history, converged, stored)


# --- reports over ranks -----------------------------------------------------------------------

def top_ranked(ranks: DataFrame, n: int) -> DataFrame:
    """Top-n nodes by rank, ties by id (a top-k report: TakeOrderedAndProject, bounded by n)."""
    return ranks.orderBy(rank_key().desc(), F.col("id").asc()).limit(n)


def titled_ranks(ranks: DataFrame, papers: DataFrame, sort: bool = False) -> DataFrame:
    """Ranks of corpus papers with their titles; ids outside the corpus drop out."""
    out = ranks.join(papers.select("id", "title"), "id")
    return out.orderBy(rank_key().desc(), F.col("id").asc()) if sort else out


def rank_total(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("rank_total"))


def sample_edges(edges: DataFrame, n: int, seed: str | int = 42) -> DataFrame:
    """``n`` edges (all when fewer) chosen by md5(seed|src|dst); copies of a parallel edge are
    interchangeable, so they share a key. A sampling operator: the limit is the feature."""
    return edges.orderBy(md5_key(seed, "src", "dst"), "src", "dst").limit(n)


def sample_subgraph(papers: DataFrame, edges: DataFrame, n: int, seed: str | int = 42, n_chars: int = 20) -> DataFrame:
    """Sample edges first, then keep those with both ends in the corpus, labelled by title."""
    sampled = sample_edges(edges, n, seed)
    titles = papers.select("id", "title")
    s = titles.select(F.col("id").alias("src"), truncate_label("title", n_chars).alias("src_label"))
    d = titles.select(F.col("id").alias("dst"), truncate_label("title", n_chars).alias("dst_label"))
    return sampled.join(s, "src").join(d, "dst").select("src", "dst", "src_label", "dst_label")


def edges_in_corpus(edges: DataFrame, papers: DataFrame, prefilter: bool = True) -> DataFrame:
    """Edges whose both endpoints are corpus papers (two semi-joins).

    ``prefilter`` tests both ends against a Bloom filter of the ids while the edges are scanned, so only
    a few per cent of those that lead out of the corpus are shuffled; the result is the same.
    Parallel edges are counted first and repeated afterwards, so the semi-joins shuffle each
    pair of ends once; a hub's pairs are left to Spark's split of skewed joins.
    """
    ids = papers.select("id")
    if prefilter:
        edges = maybe_members(edges, bloom_words(ids, "id"), "src", "dst")
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    kept = pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return kept.select("src", "dst", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("n")).select("src", "dst")


def corpus_subsets_by_rank(papers: DataFrame, edges: DataFrame, ranks: DataFrame,
                           sizes: list[int]) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each size, that many best-ranked papers and the edges among them (corpus-size experiments)."""
    titled = titled_ranks(ranks, papers).select("id", "rank")
    out = {}
    for n in sizes:
        sub = papers.join(top_ranked(titled, n).select("id"), "id", "left_semi")
        out[n] = (sub, edges_in_corpus(edges, sub))
    return out


def corpus_subset_by_rank(papers: DataFrame, edges: DataFrame, ranks: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` best-ranked papers and the edges among them."""
    return corpus_subsets_by_rank(papers, edges, ranks, [n])[n]
