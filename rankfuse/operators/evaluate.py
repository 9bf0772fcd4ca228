"""Evaluation workloads: query generation, alpha sweeps, result-set differences, positions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyze, seeded_shuffle
from ..sources.io import stage
from .envelope import keys as order_keys
from .features import Bm25Index, query_terms
from .graph import rank_key
from .matches import Asked, Matches, Scores
from .ordering import sample_rows, top_fraction_by, topn_per_group
from .search import CountedPositions, blend, position_of, positions_by_blocks, result_order, score_key, with_alphas

DEFAULT_SEED = "42"


def query_database(titled: DataFrame, n_queries: int = 1000, n_words: int = 5, fraction: float = 0.1,
                   seed: str | int = DEFAULT_SEED) -> DataFrame:
    """Queries of ``n_words`` random words from titles of randomly chosen top-ranked papers.

    Papers with at least ``n_words`` analyzed words -> best ``int(fraction * count)`` by rank
    (exact, distributed cut) -> ``n_queries`` chosen by md5 -> words shuffled by md5 -> first
    ``n_words`` joined by a space. ``query_id`` is the paper the words came from.
    """
    words = analyze(F.col("title"))
    eligible = stage(titled.where(F.size(words) >= n_words).select("id", "rank"), "eligible")  # the texts are analysed once
    top = top_fraction_by(eligible, rank_key(), [F.col("id").asc()], fraction)
    ids = sample_rows(top.select("id"), n_queries, seed, "id")  # n_queries rows at most
    chosen = titled.join(F.broadcast(ids), "id").select("id", words.alias("words"))
    picked = F.slice(seeded_shuffle(F.col("words"), seed, F.col("id")), 1, n_words)
    return chosen.select(F.col("id").alias("query_id"), F.array_join(picked, " ").alias("query"))


def sweep_prefilter(scored: DataFrame, alphas: Sequence[float], n: int) -> DataFrame:
    """Drop candidates that are provably outside the top-n at *every* grid alpha.

    For each query a small probe set (its top-n at up to five grid alphas, <= 5n rows) gives,
    per alpha, the n-th best key among the probes: a lower bound of the true n-th best key. A
    candidate whose key is strictly below that bound at every alpha has n probes ahead of it
    everywhere, so it can enter no result set. Exact: no row that could be selected is dropped.
    """
    alphas = [float(a) for a in alphas]
    k = len(alphas)
    probe_idx = sorted({0, k - 1, k // 4, k // 2, (3 * k) // 4})
    probes = [alphas[i] for i in probe_idx]
    p = with_alphas(scored, probes).withColumn("score", blend(F.col("lex"), F.col("pr"), F.col("alpha")))
    top = topn_per_group(p, ["query_id", "alpha"], result_order(), n).select("query_id", "id", "lex", "pr").distinct()
    grid = F.array(*[F.lit(a) for a in alphas])
    probe_sets = top.groupBy("query_id").agg(F.collect_list(F.struct("lex", "pr")).alias("u"))
    thresholds = probe_sets.select(
        "query_id",
        F.transform(grid, lambda a: F.try_element_at(
            F.sort_array(F.transform("u", lambda u: score_key(blend(u["lex"], u["pr"], a))), asc=False), F.lit(n)
        )).alias("thr"),
    )
    wide = thresholds.select("query_id", *[F.col("thr")[i].alias(f"__t{i}") for i in range(k)])
    j = scored.join(wide, "query_id", "left")
    # a flat OR of k comparisons (compiled by whole-stage codegen, short-circuits on survivors)
    keep = reduce(or_, [
        F.col(f"__t{i}").isNull() | (score_key(blend(F.col("lex"), F.col("pr"), a)) >= F.col(f"__t{i}"))
        for i, a in enumerate(alphas)
    ])
    return j.where(keep).drop(*[f"__t{i}" for i in range(k)])


def alpha_sweep(scored: DataFrame, alphas: Sequence[float], n: int = 100, prefilter: bool = True) -> DataFrame:
    """Top-n per (query, alpha) of ``alpha * lex + (1 - alpha) * pr`` over candidates
    ``scored(query_id, id, lex, pr)``; lexical and rank parts are computed once, blended per alpha.

    ``prefilter`` first drops candidates that can enter no result set; the results are equal. It
    pays with many candidates for each query and costs a pass over them with few."""
    if prefilter:
        scored = sweep_prefilter(scored, alphas, n)
    s = with_alphas(scored, alphas).withColumn("score", blend(F.col("lex"), F.col("pr"), F.col("alpha")))
    top = topn_per_group(s, ["query_id", "alpha"], result_order(), n)
    return top.select("query_id", "alpha", F.col("pos").cast("long").alias("pos"), "id", "score", "lex", "pr")


def resultset_diff(r1: DataFrame, r2: DataFrame, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """Difference of two result sets per key: sum over the union of |s1 - s2| (absent = 0),
    divided by S1 + S2; 0 when that sum is 0. Inputs ``(key..., id, score)``."""
    key = list(key)
    a = r1.select(*key, "id", F.col("score").alias("s1"))
    b = r2.select(*key, "id", F.col("score").alias("s2"))
    u = a.join(b, key + ["id"], "full_outer").select(
        *key, F.coalesce("s1", F.lit(0.0)).alias("s1"), F.coalesce("s2", F.lit(0.0)).alias("s2")
    )
    g = u.groupBy(*key).agg(
        F.sum(F.abs(F.col("s1") - F.col("s2"))).alias("num"), (F.sum("s1") + F.sum("s2")).alias("z")
    )
    return g.select(*key, F.when(F.col("z") == 0, F.lit(0.0)).otherwise(F.col("num") / F.col("z")).alias("difference"))


def alpha_differences_join(results: DataFrame, queries: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """``(query_id, alpha1, alpha2, difference)`` for every query and alpha pair a1 < a2.

    Uses ``sum |s1 - s2| = S1 + S2 - 2 * sum_overlap min(s1, s2)``: only documents present in both
    sets are paired (self-join on (query, id); at most one row per alpha, so a group pairs at
    most grid-size rows), and totals come from one grouped sum.
    """
    r = results.select("query_id", "alpha", "id", "score")
    totals = r.groupBy("query_id", "alpha").agg(F.sum("score").alias("total"))
    qa = with_alphas(queries.select("query_id").distinct(), alphas)
    qa = qa.join(totals, ["query_id", "alpha"], "left").select(
        "query_id", "alpha", F.coalesce("total", F.lit(0.0)).alias("total")
    )
    p1 = qa.select("query_id", F.col("alpha").alias("alpha1"), F.col("total").alias("t1"))
    p2 = qa.select("query_id", F.col("alpha").alias("alpha2"), F.col("total").alias("t2"))
    pairs = p1.join(p2, "query_id").where(F.col("alpha1") < F.col("alpha2"))
    x = r.select("query_id", "id", F.col("alpha").alias("alpha1"), F.col("score").alias("s1"))
    y = r.select("query_id", "id", F.col("alpha").alias("alpha2"), F.col("score").alias("s2"))
    overlap = x.join(y, ["query_id", "id"]).where(F.col("alpha1") < F.col("alpha2")).groupBy(
        "query_id", "alpha1", "alpha2"
    ).agg(F.sum(F.least("s1", "s2")).alias("both"))
    j = pairs.join(overlap, ["query_id", "alpha1", "alpha2"], "left")
    z = F.col("t1") + F.col("t2")
    num = z - 2.0 * F.coalesce(F.col("both"), F.lit(0.0))
    return j.select(
        "query_id", "alpha1", "alpha2",
        F.when(z == 0, F.lit(0.0)).otherwise(num / z).alias("difference"),
    )


def _pairwise_differences(alphas: Sequence[float]):
    """Per-query kernel: overlap sums of all alpha pairs as two matrix products.

    ``min(s_a1, s_a2)`` for a1 < a2 is ``s_a1`` when lex >= pr (the blend grows with alpha) and
    ``s_a2`` otherwise, so with X the membership matrix (docs x alphas) and S the scores:
    overlap = S_up^T X_up + X_dn^T S_dn, upper triangle.
    """
    import numpy as np
    import pandas as pd

    grid = np.asarray([float(a) for a in alphas])
    k = len(grid)
    iu = np.triu_indices(k, 1)

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        qid = key[0]
        col = pdf["a"].to_numpy()
        row, docs = pd.factorize(pdf["id"])
        S = np.zeros((len(docs), k))
        X = np.zeros((len(docs), k))
        S[row, col] = pdf["score"].to_numpy()
        X[row, col] = 1.0
        up = np.zeros(len(docs), dtype=bool)
        up[row] = pdf["up"].to_numpy()
        overlap = S[up].T @ X[up] + X[~up].T @ S[~up]
        tot = S.sum(axis=0)
        z = tot[:, None] + tot[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.where(z == 0, 0.0, (z - 2.0 * overlap) / np.where(z == 0, 1.0, z))
        return pd.DataFrame({"query_id": qid, "alpha1": grid[iu[0]], "alpha2": grid[iu[1]], "difference": d[iu]})

    return kernel


def alpha_differences(results: DataFrame, queries: DataFrame, alphas: Sequence[float],
                      scored: DataFrame | None = None) -> DataFrame:
    """``(query_id, alpha1, alpha2, difference)`` for every query and alpha pair a1 < a2.

    Grouped by query: one query's results hold at most (grid size x n) rows, a bound set by the
    parameters, not by the data, so the pairwise sums run as a vectorised kernel in its task.
    Queries without any result get difference 0 for every pair. ``scored`` supplies lex/pr when
    the results do not carry them.
    """
    alphas = sorted(float(a) for a in alphas)
    r = results.select("query_id", "alpha", "id", "score")
    if "lex" in results.columns and "pr" in results.columns:
        r = results.select("query_id", "alpha", "id", "score", "lex", "pr")
    elif scored is not None:
        r = r.join(scored.select("query_id", "id", "lex", "pr"), ["query_id", "id"])
    else:
        return alpha_differences_join(results, queries, alphas)
    schema = "query_id string, alpha1 double, alpha2 double, difference double"
    index = F.array_position(F.array(*[F.lit(a) for a in alphas]), F.col("alpha")) - 1
    slim = r.select("query_id", index.cast("int").alias("a"), "id", "score", (F.col("lex") >= F.col("pr")).alias("up"))
    found = slim.groupBy("query_id").applyInPandas(_pairwise_differences(alphas), schema)
    missing = queries.select("query_id").distinct().join(r.select("query_id"), "query_id", "left_anti")
    grid = F.array(*[F.lit(a) for a in alphas])
    k = len(alphas)
    zeros = (
        missing.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
        .select("query_id", "i", F.explode(F.sequence(F.col("i"), F.lit(k - 1))).alias("j"))
        .where(F.col("i") < F.col("j"))
        .select("query_id", F.element_at(grid, F.col("i") + 1).alias("alpha1"),
                F.element_at(grid, F.col("j") + 1).alias("alpha2"), F.lit(0.0).alias("difference"))
    )
    return found.unionByName(zeros)


def _matched_sizes(matches: Matches, queries: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """``required_size`` of all matches, counted where the index's documents are scored: a task's counts are a
    row a query. The targets' keys (one row a query) are collected, as the queries' words are."""
    alphas = [float(a) for a in alphas]
    own = query_terms(queries).select("query_id", "term", "qtf", F.col("query_id").alias("id"))
    lines = matches.index.postings.join(F.broadcast(own), ["term", "id"]).groupBy("query_id").agg(
        F.sum(F.col("qtf") * F.col("w")).alias("lex"), F.max("pr").alias("pr"))
    place = {q: i for i, q in enumerate(matches.ask.names)}
    found = [r for r in lines.collect() if r["query_id"] in place]
    at = np.array([place[r["query_id"]] for r in found], int)
    wanted = [r["query_id"].encode() for r in found]
    lex, pr = (np.array([r[c] for r in found], float) for c in ("lex", "pr"))
    limits = [order_keys(lex, pr, a)[1][:, None] for a in alphas]
    names = [f"a{i}" for i in range(len(alphas))]

    def kernel(parts: Iterator[Scores], ask: Asked) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(alphas), len(at)), np.int64)
        for part in parts:
            ids = [i.encode() for i in part.ids.to_pylist()]
            first = np.array([bisect_left(ids, t) for t in wanted], int)[:, None]
            here = np.arange(len(ids))
            itself = np.array([i < len(ids) and ids[i] == t for i, t in zip(first[:, 0], wanted)], bool)[:, None] & (here == first)
            match, smaller = part.hit[at] & ~itself, here < first
            for i, a in enumerate(alphas):
                key = order_keys(part.lex[at], part.pr, a)[1]
                counts[i] += (match & ((key > limits[i]) | ((key == limits[i]) & smaller))).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([ask.names[q] for q in at], pa.string()), *map(pa.array, counts)], names=["query_id", *names])

    counted = matches.run(kernel, ", ".join(["query_id string", *[f"{c} long" for c in names]]))
    times = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("__times"))  # a repeated query's matches count as often
    sums = counted.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in names]).join(times, "query_id")
    pairs = F.array(*[F.struct(F.lit(a).alias("alpha"), (F.col(c) * F.col("__times") + 1).alias("size")) for a, c in zip(alphas, names)])
    per_alpha = sums.select("query_id", F.explode(pairs).alias("x")).select("query_id", "x.alpha", "x.size")
    return with_alphas(queries.select("query_id"), alphas).join(per_alpha, ["query_id", "alpha"], "left")


def required_size(scored: DataFrame | Matches, queries: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """``(query_id, alpha, size)``: position of the query's source paper among matching documents
    ordered by the blended score (NULL when the source does not match)."""
    if isinstance(scored, Matches):
        if scored.small:
            return _matched_sizes(scored, queries, alphas)
        scored = scored.frame()
    targets = queries.select("query_id", F.col("query_id").alias("target_id"))
    return position_of(scored, targets, alphas)


def required_size_by_blocks(queries: DataFrame, index: Bm25Index, alphas: Sequence[float]) -> CountedPositions:
    """``required_size`` of a stored index, without its matches: most blocks are counted by their bounds."""
    targets = queries.select("query_id", F.col("query_id").alias("target_id"))
    return positions_by_blocks(queries, targets, index, alphas)


def first_hit_counts(sizes: DataFrame) -> DataFrame:
    """How many (query, alpha) rows have the source paper first."""
    return sizes.groupBy((F.col("size") == 1).alias("first_hit")).agg(F.count(F.lit(1)).alias("count"))
