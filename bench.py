"""Headline-query benchmark. Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The stages of one workload in order, each forced by a full write: PageRank over both graphs,
the index tables, the query set and its matches, then the queries that read those tables. Every
stage is timed once and includes all the work that no earlier stage has stored.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankfuse.operators import graph as gr  # noqa: E402
from rankfuse.operators import search as se  # noqa: E402
from rankfuse.plans import workload as W  # noqa: E402
from rankfuse.session import local_session  # noqa: E402
from rankfuse.sources import testdata  # noqa: E402


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="rankfuse-bench")
    w = W.Workload(spark, sf_dir)

    def pagerank_purchases():
        return gr.pagerank(testdata.purchase_edges(spark, sf_dir), damping=W.DAMPING, max_iter=W.PR_STEPS, tol=None).ranks

    def search_batch_topk():
        return se.search_topk(w.qdb(), w.tfidf(), W.SEARCH_TOP_N, W.SEARCH_ALPHA, W.SEARCH_BETA)

    plan = {
        "pagerank": w.ranks,
        "pagerank_purchases": pagerank_purchases,
        "build_tfidf": lambda: w.tfidf().postings,
        "build_bm25": lambda: w.bm25().postings,
        "build_queries": w.qdb,
        "search_topk": w.flagship,
        "search_batch_topk": search_batch_topk,
        "match_queries": w.matched,
        "alpha_differences": lambda: w.differences(W.BENCH_ALPHAS),
        "required_size_by_alpha": w.sizes,
    }
    times = {}
    force(spark.range(10))  # JVM warm-up, not timed
    for name, query in plan.items():
        t0 = time.time()
        force(query())
        times[name] = round(time.time() - t0, 3)
    w.release()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
