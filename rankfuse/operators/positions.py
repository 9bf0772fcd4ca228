"""Positions of targets counted where the blocks are (see ``search.positions_by_blocks``).

Bounds and postings of the queries' words are dealt by block, once. The task that holds a block decides for
every query whether its bounds settle it, and scores the documents of the others: what leaves a task is a row
of counts for each query, and no row for a query and block is shuffled or written.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .envelope import keys
from .features import BLOCK_DOCS
from .matches import CELLS, DOCS, Asked, Matches, score, tables_by


class Lines:
    """The targets: their queries' places ``at``, ids (UTF-8) and order keys for each alpha."""

    def __init__(self, names: list[str], rows: list, alphas: Sequence[float]):
        place = {q: i for i, q in enumerate(names)}
        found = [r for r in rows if r["query_id"] in place]
        self.at = np.array([place[r["query_id"]] for r in found], int)
        self.ids = [r["target_id"].encode() for r in found]
        self.limits = [np.array([r[f"t{i}"] for r in found], float)[:, None] for i in range(len(alphas))]


def decided(ask: Asked, lines: Lines, cells: pa.Table, alphas: Sequence[float], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the targets' queries and some blocks: which cells are open, how many documents the closed ones count for
    each alpha, and the blocks."""
    coded = pc.dictionary_encode(cells.column("block").combine_chunks())
    code, n = coded.indices.to_numpy(), len(coded.dictionary)
    word = cells.column("word").to_numpy()

    def grid(column: str, empty: float) -> np.ndarray:
        out = np.full((len(ask.words), n), empty)
        out[word, code] = cells.column(column).to_numpy()
        return out

    top_w, top_pr, low_w, low_pr, many = grid("w", 0.0), grid("pr", -np.inf), grid("low_w", np.inf), grid("low_pr", np.inf), grid("n", 0.0)
    shape = len(ask.names), n
    most, least, count, words = np.zeros(shape), np.full(shape, np.inf), np.zeros(shape), np.zeros(shape, int)
    high, low = np.full(shape, -np.inf), np.full(shape, np.inf)
    for queries, terms, times in ask.slots:
        most[queries] += top_w[terms] * times[:, None]
        least[queries] = np.minimum(least[queries], low_w[terms] * times[:, None])
        high[queries], low[queries] = np.maximum(high[queries], top_pr[terms]), np.minimum(low[queries], low_pr[terms])
        count[queries] += many[terms]
        words[queries] += many[terms] > 0
    most, least, high, low, count, words = (x[lines.at] for x in (most, least, high, low, count, words))
    hit = words > 0
    high, low, least = np.where(hit, high, 0.0), np.where(hit, low, 0.0), np.where(hit, least, 0.0)
    opened, surely = np.zeros(hit.shape, bool), []
    for a, limit in zip(alphas, lines.limits):
        up, down = a * most + (1.0 - a) * high, a * least + (1.0 - a) * low
        after = keys(up + np.abs(up) * slack, up, 1.0)[1] < limit
        before = (keys(down - np.abs(down) * slack, down, 1.0)[1] > limit) & (words == 1)
        opened |= hit & ~(after | before)
        surely.append(np.where(hit & before, count, 0.0))
    return opened, np.stack([np.where(opened, 0.0, s).sum(1) for s in surely]).astype(np.int64), np.asarray(coded.dictionary)


def counted(matches: Matches, targets: DataFrame, cells: DataFrame, alphas: Sequence[float], slack: float) -> DataFrame:
    """``query_id, a0, a1...``: documents before each query's target (``targets``: ``query_id, target_id, t0, t1...``),
    by alpha, a row for each query and task. ``cells``: the index's block bounds."""
    ask, names = matches.ask, [f"a{i}" for i in range(len(alphas))]
    lines = Lines(ask.names, targets.collect(), alphas)
    none = lambda kind: F.lit(None).cast(kind)
    bounds = cells.select("term", "block", none("string").alias("id"), F.col("top_w").alias("w"), F.col("top_pr").alias("pr"), "low_w", "low_pr", "n")
    own = matches.index.postings.select("term", "block", "id", "w", "pr", none("double").alias("low_w"), none("double").alias("low_pr"), none("long").alias("n"))
    rows = bounds.unionByName(own).join(matches.words(), "term").drop("term").repartition(matches.tasks(), "block").sortWithinPartitions("block", "id")
    sent = matches.queries.sparkSession.sparkContext.broadcast((ask, lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, lines = sent.value
        total = np.zeros((len(alphas), len(lines.at)), np.int64)
        docs = max(1, min(DOCS, CELLS // max(1, len(ask.words), len(ask.names))))
        for table in tables_by(batches, "block", max(1, docs // BLOCK_DOCS)) if len(lines.at) else ():
            bound = pc.is_null(table.column("id"))
            opened, closed, blocks = decided(ask, lines, table.filter(bound), alphas, slack)
            total += closed
            wide = blocks[opened.any(0)]
            held = table.filter(pc.and_(pc.invert(bound), pc.is_in(table.column("block"), pa.array(wide))))
            for part in tables_by(iter(held.sort_by("id").to_batches()), "id", docs):
                coded = pc.dictionary_encode(part.column("id").combine_chunks())
                code, ids = coded.indices.to_numpy(), [i.encode() for i in coded.dictionary.to_pylist()]
                got = score(ask, coded.dictionary, code, *(part.column(c).to_numpy() for c in ("word", "w", "pr")))
                block = np.zeros(len(ids), np.int64)
                block[code] = part.column("block").to_numpy()
                first = np.array([bisect_left(ids, t) for t in lines.ids], int)[:, None]
                here = np.arange(len(ids))
                itself = np.array([i < len(ids) and ids[i] == t for i, t in zip(first[:, 0], lines.ids)], bool)[:, None] & (here == first)
                match = got.hit[lines.at] & ~itself & opened[:, np.searchsorted(blocks, block)]
                for i, (a, limit) in enumerate(zip(alphas, lines.limits)):
                    key = keys(got.lex[lines.at], got.pr, a)[1]
                    total[i] += (match & ((key > limit) | ((key == limit) & (here < first)))).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([ask.names[q] for q in lines.at], pa.string()), *map(pa.array, total)], names=["query_id", *names])

    return rows.mapInArrow(run, ", ".join(["query_id string", *[f"{c} long" for c in names]]))
