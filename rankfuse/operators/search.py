"""Batch search: every query of a table scored at once by joining query terms to postings.

Two candidate modes, as in the original:

* ``all`` (feature-store scoring): every stored document is a candidate; documents sharing no
  word score ``beta * pr``. Without building queries x corpus: for non-negative weights the
  top-n of a query lies within its matching documents plus the global top-n by
  ``(beta * pr, id)`` (each of those n beats any other non-matching document), so exactly those
  n rows are added per query.
* ``matching`` (index scoring): only documents sharing a word with the query.

Scores are ordered by their leading 33 bits, then ``id``: float noise never decides a tie, and
scores of any magnitude keep their order.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.io import stage
from .features import BLOCK_DOCS, Bm25Index, TfidfIndex, query_terms, query_weights
from .ordering import significant, spread_join, topn_per_group

if TYPE_CHECKING:
    from .matches import Matches


def score_key(col: str | Column = "score") -> Column:
    """Order key of a score, relative to its own magnitude (see ``ordering.significant``)."""
    return significant(F.col(col) if isinstance(col, str) else col)


def result_order(score_col: str = "score") -> list[Column]:
    return [score_key(score_col).desc(), F.col("id").asc()]


def hybrid_score(lex: Column, pr: Column, alpha: float, beta: float) -> Column:
    """``alpha * lexical + beta * rank``."""
    return F.lit(float(alpha)) * lex + F.lit(float(beta)) * pr


def cosine_contribs(queries: DataFrame, index: TfidfIndex) -> DataFrame:
    """``(query_id, id, c, pr)``: one row per shared (query, document, term)."""
    both = _asked_postings(query_weights(queries, index), index, index.postings)
    return both.select("query_id", "id", (F.col("qnw") * F.col("nw")).alias("c"), "pr")


def cosine_scores(queries: DataFrame, index: TfidfIndex) -> DataFrame:
    """``(query_id, id, cosine, pr)`` for documents sharing at least one word with the query."""
    return cosine_contribs(queries, index).groupBy("query_id", "id").agg(
        F.sum("c").alias("cosine"), F.max("pr").alias("pr")
    )


def _rank_fill(queries: DataFrame, docs: DataFrame, n: int, beta: float) -> DataFrame:
    """Per query, the global top-n documents by (beta*pr, id) with zero lexical score.

    The n rows (bounded by the parameter) are fetched once and attached to each query as a
    literal array, so no join of queries with the corpus is planned.
    """
    top = docs.orderBy(score_key(F.lit(float(beta)) * F.col("pr")).desc(), F.col("id").asc()).limit(n).collect()
    if not top:
        return queries.select("query_id").where(F.lit(False)).select(
            "query_id", F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("c"), F.lit(0.0).alias("pr")
        )
    fill = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(float(r["pr"])).alias("pr")) for r in top])
    return queries.select("query_id", F.explode(fill).alias("d")).select(
        "query_id", F.col("d.id").alias("id"), F.lit(0.0).alias("c"), F.col("d.pr").alias("pr")
    )


def search_topk(queries: DataFrame, index: TfidfIndex, n: int = 10, alpha: float = 1.0, beta: float = 0.0,
                mode: str = "all") -> DataFrame:
    """Top-n documents per query by ``alpha * cosine + beta * pr``.

    Returns ``(query_id, pos, id, score, cosine, pr)``. ``mode='all'`` reproduces scoring every
    stored document (needs ``alpha, beta >= 0``); ``mode='matching'`` keeps sharing documents only.
    """
    if mode not in ("all", "matching"):
        raise ValueError("mode must be 'all' or 'matching'")
    if mode == "all" and (alpha < 0 or beta < 0):
        raise ValueError("mode='all' needs non-negative alpha and beta")
    scored = cosine_scores(queries, index).withColumn("score", hybrid_score(F.col("cosine"), F.col("pr"), alpha, beta))
    top = topn_per_group(scored, ["query_id"], result_order(), n)
    if mode == "all":  # a matching document that isn't here has n others before it with its own score, and with its rank's too
        known = top.select("query_id", "id", F.col("cosine").alias("c"), "pr").unionByName(_rank_fill(queries, index.docs, n, beta))
        scored = known.groupBy("query_id", "id").agg(F.sum("c").alias("cosine"), F.max("pr").alias("pr"))
        scored = scored.withColumn("score", hybrid_score(F.col("cosine"), F.col("pr"), alpha, beta))
        top = topn_per_group(scored, ["query_id"], result_order(), n)
    return top.select("query_id", F.col("pos").cast("long").alias("pos"), "id", "score", "cosine", "pr")


def one_query(spark, query: str, query_id: str = "q") -> DataFrame:
    return spark.createDataFrame([(query_id, query)], "query_id string, query string")


def score_documents(spark, query: str, index: TfidfIndex) -> DataFrame:
    """``(id, cosine, pr)`` of *every* stored document for one query; 0.0 where no word is shared."""
    found = cosine_scores(one_query(spark, query), index).select("id", "cosine")
    return index.docs.join(found, "id", "left").select("id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "pr")


def full_ranking(spark, query: str, index: TfidfIndex, papers: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """All documents for one query with their text, globally sorted: ``(id, title, cosine, pr, score)``.

    One query only: the same for a batch would be a row for each query and document."""
    scored = score_documents(spark, query, index)
    scored = scored.withColumn("score", hybrid_score(F.col("cosine"), F.col("pr"), alpha, beta))
    return scored.join(papers.select("id", "title"), "id").select("id", "title", "cosine", "pr", "score").orderBy(*result_order())


# --- lexical index (BM25) path ----------------------------------------------------------------

def match_any(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """``(query_id, id)`` of documents containing at least one query word."""
    holders = (index.terms if index.terms is not None else index.postings).select("term", "id")
    return _asked_postings(query_terms(queries), index, holders).select("query_id", "id").distinct()


#: Rows of queries and postings that one task joins and counts, about.
PAIR_ROWS = 2_000_000


def _asked_postings(words: DataFrame, index: TfidfIndex | Bm25Index, postings: DataFrame) -> DataFrame:
    """``postings`` joined with the queries that have their term (``words``: ``query_id, term`` and a number).

    If the queries' words are few enough to broadcast, only the postings of these words are moved, dealt by
    document, and a document's rows for all queries arise in one task: what is grouped by query and
    document then isn't shuffled. There are as many tasks as keep these groups in memory."""
    few = broadcast_small(words)
    if few is words:
        return spread_join(postings, words, "term", index.hot, "id")
    asked = [c for c in words.columns if c != "term"]
    asks = words.groupBy("term").agg(F.collect_list(F.struct(*asked)).alias("asks"), F.count(F.lit(1)).alias("n"))
    pairs = index.vocab.join(F.broadcast(asks), "term").agg(F.sum(F.col("df") * F.col("n"))).first()[0] or 0
    parts = max(shuffle_partitions(words.sparkSession), -(-int(pairs) // PAIR_ROWS))
    held = postings.join(F.broadcast(asks.select("term")), "term", "left_semi").repartition(parts, "id")
    each = held.join(F.broadcast(asks.drop("n")), "term").withColumn("__ask", F.explode("asks"))
    return each.select(*[f"__ask.{c}" for c in asked], *[c for c in postings.columns])


def bm25_scores(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """``(query_id, id, lex, pr)``: BM25 over matching documents, with the stored rank."""
    return _asked_postings(query_terms(queries), index, index.postings.select("term", "id", "w", "pr")).groupBy("query_id", "id").agg(
        F.sum(F.col("qtf") * F.col("w")).alias("lex"), F.max("pr").alias("pr")
    )


def blend(lex: Column, pr: Column, alpha: float | Column) -> Column:
    """Index-path blend ``alpha * lex + (1 - alpha) * pr``."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * lex + (F.lit(1.0) - a) * pr


#: Blocks of a query that are scored first, to learn what a document needs for its top-n: as many as
#: hold this many times ``n`` documents, and a few more.
FIRST_BLOCKS = 2
#: Bounds are sums in another order than scores: they are trusted up to this share.
BOUND_SLACK = 1e-8


def cell_bounds(queries: DataFrame, index: Bm25Index, alpha: float) -> DataFrame:
    """``(query_id, block, bound, n)``: no document of the block scores above ``bound``; ``n`` postings match."""
    held = spread_join(index.blocks, query_terms(queries), "term", index.hot, "block")
    cells = held.groupBy("query_id", "block").agg(
        F.sum(F.col("qtf") * F.col("top_w")).alias("lex"), F.max("top_pr").alias("pr"), F.sum("n").alias("n"))
    return cells.select("query_id", "block", blend(F.col("lex"), F.col("pr"), alpha).alias("bound"), "n")


def _cell_parts(queries: DataFrame, index: Bm25Index, cells: DataFrame, few: bool = False) -> DataFrame:
    """``(query_id, id, lex, pr)`` of the documents in these (query, block) cells."""
    wanted = query_terms(queries).join(cells.select("query_id", "block"), "query_id")
    found = index.postings.join(broadcast_small(wanted) if few else wanted, ["term", "block"])
    return found.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("w")).alias("lex"), F.max("pr").alias("pr"))


def _cell_scores(queries: DataFrame, index: Bm25Index, cells: DataFrame, alpha: float, few: bool = False) -> DataFrame:
    """``_cell_parts`` with their ``score``."""
    return _cell_parts(queries, index, cells, few).withColumn("score", blend(F.col("lex"), F.col("pr"), alpha))


@dataclass
class PrunedSearch:
    """``top`` as by ``bm25_hybrid_topk``; ``cells`` (``query_id, block, n, scored``) tells what was skipped."""

    top: DataFrame
    cells: DataFrame


def pruned_topk(queries: DataFrame, index: Bm25Index, alpha: float = 0.5, n: int = 200) -> PrunedSearch:
    """Top-n matching documents per query, scoring only blocks that can hold one (block-max).

    A block's bound for a query is what a document would score that had the block's largest weight
    of every query term and its largest rank. The blocks with the highest bounds are scored first;
    the n-th best score found there is what any other document needs, so of the other blocks only
    those are scored whose bound reaches it. Exact; ``alpha`` must be in 0 to 1.

    Bounds are computed where the blocks are, for all queries at once (``matches``): no row for each query and
    block is shuffled or written (``cells`` makes them only for who reads it). Postings move if their word and
    block can reach the top of a query, and each task gives back what can be among the best.
    """
    from .matches import Matches  # which needs this module

    if index.blocks is None:
        raise ValueError("this index has no block bounds: build it with a store")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in 0 to 1")
    first = 4 + FIRST_BLOCKS * -(-n // BLOCK_DOCS)
    found = Matches(queries, index)
    if found.small and n > 0:
        return _pruned_in_tasks(found, alpha, n, first)
    cells = stage(cell_bounds(queries, index, alpha), "cells")
    order = [F.col("bound").desc(), F.col("block").asc()]
    leading = topn_per_group(cells, ["query_id"], order, first).select("query_id", "block", F.lit(True).alias("leads"))
    cells = stage(cells.join(leading, ["query_id", "block"], "left"), "ordered-cells")
    early = stage(_cell_scores(queries, index, cells.where("leads"), alpha), "early-scores")
    needed = topn_per_group(early, ["query_id"], result_order(), n).where(F.col("pos") == n).select("query_id", F.col("score").alias("needed"))
    reaches = F.col("needed").isNull() | (F.col("bound") >= F.col("needed") - F.abs("needed") * BOUND_SLACK)
    told = cells.join(needed, "query_id", "left").select("query_id", "block", "n", "leads", (F.col("leads").isNotNull() | reaches).alias("scored"))
    late = told.where(F.col("scored") & F.col("leads").isNull())
    both = early.unionByName(_cell_scores(queries, index, late, alpha))
    top = topn_per_group(both, ["query_id"], result_order(), n)
    return PrunedSearch(top.select("query_id", F.col("pos").cast("long").alias("pos"), "id", "score", "lex", "pr"), told.drop("leads"))


def _pruned_in_tasks(found: Matches, alpha: float, n: int, first: int) -> PrunedSearch:
    """``pruned_topk`` of queries whose words go to the tasks."""
    import numpy as np

    from .matches import leading, reaching, topmost

    queries, index, names = found.queries, found.index, found.ask.names
    bounds = index.blocks.select("term", F.col("block").alias("id"), F.col("top_w").alias("w"), F.col("top_pr").alias("pr"))
    best = found.run(leading(alpha, first), "query_id string, block long, bound double", bounds)
    leads = stage(topn_per_group(best, ["query_id"], [F.col("bound").desc(), F.col("block").asc()], first).select("query_id", "block"), "leading-cells")
    early = _cell_scores(queries, index, leads, alpha, few=True)
    needs = topn_per_group(early, ["query_id"], result_order(), n).where(F.col("pos") == n).select("query_id", F.col("score").alias("needed")).collect()
    known = {r["query_id"]: r["needed"] - abs(r["needed"]) * BOUND_SLACK for r in needs}
    needed = np.array([known.get(q, -np.inf) for q in names])
    wanted = stage(found.run(reaching(alpha, needed), "term string, block long", bounds), "wanted-blocks")
    few = broadcast_small(wanted)
    postings = index.postings if few is wanted else index.postings.join(few, ["term", "block"], "left_semi")
    scored = found.run(topmost(alpha, needed, n, BOUND_SLACK), "query_id string, id string, lex double, pr double", postings)
    scored = scored.withColumn("score", blend(F.col("lex"), F.col("pr"), alpha))
    top = topn_per_group(scored, ["query_id"], result_order(), n)
    least = queries.sparkSession.createDataFrame(sorted(known.items()), "query_id string, needed double")
    told = cell_bounds(queries, index, alpha).where(F.col("query_id").isNotNull()).join(least, "query_id", "left")
    told = told.join(leads.withColumn("leads", F.lit(True)), ["query_id", "block"], "left").select(
        "query_id", "block", "n", (F.col("leads").isNotNull() | F.col("needed").isNull() | (F.col("bound") >= F.col("needed"))).alias("scored"))
    return PrunedSearch(top.select("query_id", F.col("pos").cast("long").alias("pos"), "id", "score", "lex", "pr"), told)


def bm25_hybrid_topk(queries: DataFrame, index: Bm25Index, alpha: float = 0.5, n: int = 200) -> DataFrame:
    """Top-n matching documents per query by ``alpha * bm25 + (1 - alpha) * pr``. Scores every match, in one
    lazy plan; ``pruned_topk`` gives the same rows of a stored index and skips blocks."""
    s = bm25_scores(queries, index).withColumn("score", blend(F.col("lex"), F.col("pr"), alpha))
    top = topn_per_group(s, ["query_id"], result_order(), n)
    return top.select("query_id", F.col("pos").cast("long").alias("pos"), "id", "score", "lex", "pr")


def with_alphas(df: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Attach each grid value to each row (a literal array, bounded by the grid size)."""
    return df.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))


#: Rows of a query table (an id or two and a few numbers each) that may be broadcast: some 50 MB.
SMALL_ROWS = 500_000


def broadcast_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``SMALL_ROWS`` rows (they are counted), else ``df``."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def position_of(scored: DataFrame, targets: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """1-based position of each query's target document in its full ordering, per alpha.

    ``scored(query_id, id, lex, pr)``; ``targets(query_id, target_id)``. Counts documents ordered
    before the target (``score > t`` or equal and smaller id) for every alpha in one grouped pass,
    no sort. The targets, one row for each query, are counted and broadcast if they are few, so the
    candidates are not shuffled to them; their counts are (partial sums). NULL when the target is
    not a candidate.
    """
    own = broadcast_small(targets)
    t = scored.join(own, "query_id").where(F.col("id") == F.col("target_id")).select(
        "query_id", F.col("lex").alias("t_lex"), F.col("pr").alias("t_pr"), "target_id"
    )
    j = scored.join(F.broadcast(t) if own is not targets else t, "query_id")
    aggs = []
    for i, a in enumerate(alphas):
        s = score_key(blend(F.col("lex"), F.col("pr"), a))
        ts = score_key(blend(F.col("t_lex"), F.col("t_pr"), a))
        before = (s > ts) | ((s == ts) & (F.col("id") < F.col("target_id")))
        aggs.append((F.count_if(before) + 1).alias(f"a{i}"))
    counts = j.groupBy("query_id").agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"a{i}").alias("size")) for i, a in enumerate(alphas)])
    per_alpha = counts.select("query_id", F.explode(pairs).alias("x")).select(
        "query_id", F.col("x.alpha").alias("alpha"), F.col("x.size").cast("long").alias("size")
    )
    base = with_alphas(targets.select("query_id"), alphas)
    return base.join(per_alpha, ["query_id", "alpha"], "left")


@dataclass
class CountedPositions:
    """``sizes`` as by ``position_of``; ``cells`` (``query_id, block, n, opened``) tells what was skipped."""

    sizes: DataFrame
    cells: DataFrame


def positions_by_blocks(queries: DataFrame, targets: DataFrame, index: Bm25Index, alphas: Sequence[float]) -> CountedPositions:
    """1-based positions of the targets, per alpha, opening only blocks that can go either way.

    The targets' own scores come first, from their own postings. A (query, block) cell none of whose
    matches can come before the target at any alpha counts nothing. One whose matches all do counts its
    postings, if one word of the query matches there, so that these are different documents; a cell
    that is one or the other at every alpha stays closed. The rest are opened and their documents
    counted. Rows as by ``position_of`` over all matches (``targets(query_id, target_id)``, one row a
    query at most); NULL when the target doesn't match. Needs a stored index and alphas in 0 to 1.

    The targets are counted and broadcast if they are few: neither cells nor documents are shuffled to them. If
    the queries' words are few too, cells are settled and documents counted in the tasks that hold a block.
    """
    from .matches import Matches  # which needs this module
    from .positions import counted

    if index.blocks is None:
        raise ValueError("this index has no block bounds: build it with a store")
    if not all(0 <= a <= 1 for a in alphas):
        raise ValueError("alphas must be in 0 to 1")
    terms = query_terms(queries)
    sought = terms.join(targets, "query_id").select("query_id", "term", "qtf", F.col("target_id").alias("id"))
    own = index.postings.join(broadcast_small(sought), ["term", "id"]).groupBy("query_id", F.col("id").alias("target_id")).agg(
        F.sum(F.col("qtf") * F.col("w")).alias("lex"), F.max("pr").alias("pr"))
    keys = [score_key(blend(F.col("lex"), F.col("pr"), a)).alias(f"t{i}") for i, a in enumerate(alphas)]
    own = stage(own.select("query_id", "target_id", *keys), "targets")
    names = [f"a{i}" for i in range(len(alphas))]
    found = Matches(queries, index)
    if found.small:
        parts = counted(found, own, index.blocks, alphas, BOUND_SLACK)
        return CountedPositions(_sizes_of(parts, names, targets, alphas),
                                _position_cells(terms, index, own, alphas).select("query_id", "block", "n", "opened"))
    own = broadcast_small(own)
    cells = stage(_position_cells(terms, index, own, alphas), "position-cells")
    docs = _cell_parts(queries, index, cells.where("opened")).join(own, "query_id")
    before = []
    for i, a in enumerate(alphas):
        s = score_key(blend(F.col("lex"), F.col("pr"), a))
        smaller = (s == F.col(f"t{i}")) & (F.col("id") < F.col("target_id"))
        before.append(((F.col("id") != F.col("target_id")) & ((s > F.col(f"t{i}")) | smaller)).cast("long").alias(f"a{i}"))
    nothing = own.select("query_id", *[F.lit(0).cast("long").alias(c) for c in names])  # a target that nothing comes before
    parts = nothing.unionByName(cells.where("not opened").select("query_id", *names)).unionByName(docs.select("query_id", *before))
    return CountedPositions(_sizes_of(parts, names, targets, alphas), cells.select("query_id", "block", "n", "opened"))


def _position_cells(terms: DataFrame, index: Bm25Index, own: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """``query_id, block, n, opened, a0, a1...``: what the bounds of each cell settle."""
    held = spread_join(index.blocks, terms, "term", index.hot, "block")
    cells = held.groupBy("query_id", "block").agg(
        F.sum(F.col("qtf") * F.col("top_w")).alias("top_lex"), F.max("top_pr").alias("top_pr"),
        F.min(F.col("qtf") * F.col("low_w")).alias("low_lex"), F.min("low_pr").alias("low_pr"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).join(own, "query_id")
    opened, surely = F.lit(False), []
    for i, a in enumerate(alphas):
        most, least = blend(F.col("top_lex"), F.col("top_pr"), a), blend(F.col("low_lex"), F.col("low_pr"), a)
        after = score_key(most + F.abs(most) * BOUND_SLACK) < F.col(f"t{i}")
        before = (score_key(least - F.abs(least) * BOUND_SLACK) > F.col(f"t{i}")) & (F.col("words") == 1)
        opened = opened | ~(after | before)
        surely.append(F.when(before, F.col("n")).otherwise(F.lit(0)).alias(f"a{i}"))
    return cells.select("query_id", "block", "n", opened.alias("opened"), *surely)


def _sizes_of(parts: DataFrame, names: Sequence[str], targets: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Positions by the counts of ``parts``, a row for each of ``targets`` and alpha."""
    sums = stage(parts.groupBy("query_id").agg(*[(F.sum(c) + 1).alias(c) for c in names]), "counted-positions")  # a row a query
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(c).alias("size")) for a, c in zip(alphas, names)])
    per_alpha = sums.select("query_id", F.explode(pairs).alias("x")).select("query_id", "x.alpha", "x.size")
    base = with_alphas(targets.select("query_id"), alphas)
    return base.join(broadcast_small(per_alpha), ["query_id", "alpha"], "left")
