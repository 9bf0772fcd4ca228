"""The standard workload over a directory of the driver's tables, built lazily and memoised.

Everything here is derived from the given tables: papers and edges (views), PageRank,
TF-IDF and BM25 indexes, the generated query set, and evaluation outputs. Indexes and matches
are tables in the session's shared folder, written once for a workload and read by all its
queries; ``release`` removes them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import geomspace, linspace
from ..operators import envelope, evaluate, features, graph, search
from ..operators.matches import Matches
from ..session import drop_path, ensure_checkpoint_dir
from ..sources import io, testdata

# Workload parameters (ours; the original used 1000 queries, 5 words, top 10 %, top 100, 100 alphas)
PR_STEPS = 10
DAMPING = 0.85
N_QUERIES = 1000
N_WORDS = 5
TOP_FRACTION = 0.1
SEED = "42"
SWEEP_TOP_N = 100
ORACLE_ALPHAS = linspace(0.0, 1.0, 11)
BENCH_ALPHAS = geomspace(1e-6, 1.0, 100)
SIZE_ALPHAS = linspace(0.0, 1.0, 10)
SEARCH_TOP_N = 10
SEARCH_ALPHA = 1.0
SEARCH_BETA = 50.0
FLAGSHIP_QUERY = "ere ent ing the research tion"


@dataclass
class Workload:
    spark: SparkSession
    sf_dir: str
    alphas: list = field(default_factory=lambda: list(ORACLE_ALPHAS))
    _memo: dict = field(default_factory=dict)

    def store(self) -> str:
        """The folder of this workload's tables."""
        return self._get("store", lambda: io.scratch(self.spark, "workload"))

    def release(self) -> None:
        """Remove the workload's tables; frames built on them can't be read any more."""
        if "store" in self._memo:
            drop_path(self.spark, self._memo["store"])
        self._memo.clear()

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    # views
    def papers(self) -> DataFrame:
        return testdata.papers(self.spark, self.sf_dir)

    def edges(self) -> DataFrame:
        return testdata.edges(self.spark, self.sf_dir)

    def papers_with_refs(self) -> DataFrame:
        return testdata.papers_with_refs(self.spark, self.sf_dir)

    def nodes(self) -> DataFrame:
        return graph.graph_nodes(self.edges(), self.papers().select("id"))

    # graph
    def pagerank(self) -> graph.PageRankResult:
        return self._get("pr", lambda: graph.pagerank(
            self.edges(), self.papers().select("id"), damping=DAMPING, max_iter=PR_STEPS, tol=None))

    def ranks(self) -> DataFrame:
        return self.pagerank().ranks

    def titled(self) -> DataFrame:
        return graph.titled_ranks(self.ranks(), self.papers())

    # text indexes
    def tfidf(self) -> features.TfidfIndex:
        return self._get("tfidf", lambda: features.build_tfidf(
            self.papers(), self.ranks(), store=self.store()))

    def bm25(self) -> features.Bm25Index:
        return self._get("bm25", lambda: features.build_bm25(
            self.papers(), self.ranks(), store=self.store()))

    # queries and evaluations
    def qdb(self) -> DataFrame:
        ensure_checkpoint_dir(self.spark)
        return self._get("qdb", lambda: evaluate.query_database(
            self.titled(), N_QUERIES, N_WORDS, TOP_FRACTION, SEED).checkpoint(eager=True))

    def matches(self) -> Matches:
        return self._get("matches", lambda: Matches(self.qdb(), self.bm25()))

    def matched(self) -> DataFrame:
        return self._get("matched", lambda: self.matches().frame())

    def sweep(self, alphas=None) -> DataFrame:
        alphas = alphas or self.alphas
        return envelope.top_for_all_alphas(self.matches(), alphas, SWEEP_TOP_N)

    def differences(self, alphas=None) -> DataFrame:
        alphas = alphas or self.alphas
        return envelope.differences_for_all_alphas(self.matches(), self.qdb(), alphas, SWEEP_TOP_N)

    def sizes(self, alphas=None) -> DataFrame:
        return evaluate.required_size(self.matches(), self.qdb(), alphas or SIZE_ALPHAS)

    def flagship(self) -> DataFrame:
        q = search.one_query(self.spark, FLAGSHIP_QUERY, "flagship")
        return search.search_topk(q, self.tfidf(), SEARCH_TOP_N, SEARCH_ALPHA, SEARCH_BETA)


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round every double column (``special`` overrides per column) for engine-neutral comparison."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append(F.round(F.col(f.name), special.get(f.name, places)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
