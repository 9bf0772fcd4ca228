"""End-to-end batch: corpus -> ranks -> indexes -> titled ranks -> queries -> evaluations.

Each stage is written once under ``out_dir``, keyed by its parameters, the input files, the code and the
stages it uses (``sources.stages``): a failed run resumes from the last finished stage, a run with
other parameters builds what depends on them, and later stages read short plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import envelope as en
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import graph as gr
from ..operators import search as se
from ..operators.matches import Matches
from ..sources import io
from ..sources import testdata as td
from ..sources.stages import Stages
from .workload import (BENCH_ALPHAS, DAMPING, N_QUERIES, N_WORDS, PR_STEPS, SEARCH_ALPHA, SEARCH_BETA, SEARCH_TOP_N, SEED, SIZE_ALPHAS,
                       SWEEP_TOP_N, TOP_FRACTION)


def run_pipeline(spark: SparkSession, sf_dir: str, out_dir: str, alphas=BENCH_ALPHAS,
                 max_iter: int = PR_STEPS, tol: float | None = None) -> dict[str, DataFrame]:
    """All stages; the outputs by name. ``stages_built`` lists the stages that this run built."""
    alphas = [float(a) for a in alphas]
    stages = Stages(spark, out_dir, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("documents", "lineitem")])
    corpus = stages.table("corpus", lambda: io.corpus_project(td.papers_with_refs(spark, sf_dir)))
    papers = corpus.select("id", "title")
    edges = stages.table("edges", lambda: gr.citation_edges(corpus), ["corpus"])
    ranks = stages.table("ranks", lambda: gr.pagerank(
        edges, papers.select("id"), damping=DAMPING, max_iter=max_iter, tol=tol).ranks, ["edges"], damping=DAMPING, max_iter=max_iter, tol=tol)
    titled = stages.table("titled_ranks", lambda: gr.titled_ranks(ranks, papers), ["ranks"])

    index = f"{stages.root}/index"
    key = stages.key("index", ["corpus", "ranks"])
    tfidf = fe.build_tfidf(papers, ranks, store=index, key=key)
    bm25 = fe.build_bm25(papers, ranks, store=index, key=key)

    queries = stages.table("queries", lambda: ev.query_database(titled, N_QUERIES, N_WORDS, TOP_FRACTION, SEED), ["titled_ranks"],
                           n=N_QUERIES, words=N_WORDS, fraction=TOP_FRACTION, seed=SEED)
    results = stages.table("results", lambda: se.search_topk(queries, tfidf, SEARCH_TOP_N, SEARCH_ALPHA, SEARCH_BETA), ["queries", "index"],
                           n=SEARCH_TOP_N, alpha=SEARCH_ALPHA, beta=SEARCH_BETA)
    stages.key("matched", ["queries", "index"])  # a row for each query and document: never stored, scored where it is used
    matched = Matches(queries, bm25)
    sweep = stages.table("alpha_sweep", lambda: en.top_for_all_alphas(matched, alphas, SWEEP_TOP_N), ["matched"], alphas=alphas, n=SWEEP_TOP_N)
    diffs = stages.table("alpha_differences", lambda: en.differences_for_all_alphas(matched, queries, alphas, SWEEP_TOP_N), ["matched", "queries"],
                         alphas=alphas, n=SWEEP_TOP_N)
    diff_stats = stages.table("alpha_stats", lambda: st.stats_global(diffs, "difference"), ["alpha_differences"])
    sizes = stages.table("required_size", lambda: ev.required_size(matched, queries, SIZE_ALPHAS), ["matched", "queries"], alphas=SIZE_ALPHAS)
    size_stats = stages.table("required_size_stats", lambda: st.stats_by_key(sizes, "size", ["alpha"]), ["required_size"])
    built = spark.createDataFrame([(n,) for n in stages.built], "stage string").orderBy(F.col("stage"))
    return {
        "corpus": corpus, "edges": edges, "ranks": ranks, "titled_ranks": titled, "postings": bm25.postings, "tfidf_weights": tfidf.weights,
        "queries": queries, "results": results, "matched": matched.frame(), "alpha_sweep": sweep, "alpha_differences": diffs, "difference_stats": diff_stats,
        "required_size": sizes, "required_size_stats": size_stats, "stages_built": built,
    }
