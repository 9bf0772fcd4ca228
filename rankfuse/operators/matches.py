"""Matches of all queries without a row for each query and document.

Of the index only the postings of query words are moved, once, dealt and sorted by document. The task that
holds a document scores it for every query, ``DOCS`` documents at a time as an array of queries times
documents, and a kernel takes what it needs of that: lines that can be among the best, or counts.
What leaves a task grows with queries times result sizes, not with matches; every match is scored.

``Matches`` stands for the rows of ``search.bm25_scores`` (``frame``). The words of the queries are collected
and sent to the tasks, up to ``search.SMALL_ROWS`` of them; beyond that ``frame`` is the only way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .features import Bm25Index, query_terms
from .search import SMALL_ROWS, bm25_scores

#: Postings of one task, about: what its sort holds in memory.
TASK_ROWS = 2_000_000
#: Cells of the arrays that a task scores together, and the documents that these hold at most.
CELLS, DOCS = 4_000_000, 1024


@dataclass
class Asked:
    """The queries' words: ``slots`` holds, for the first, second... word of each query that has so many, the
    queries, the words (numbers) and how often the query has them."""

    names: list[str]
    words: list[str]
    slots: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Scores:
    """Some documents, ascending by id: ``lex`` and ``hit`` are queries times documents."""

    ids: pa.Array
    pr: np.ndarray
    lex: np.ndarray
    hit: np.ndarray
    held: np.ndarray  # words times documents


def asked(rows: list[tuple[str, str, int]]) -> Asked:
    names, words = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    at, word = {q: i for i, q in enumerate(names)}, {w: i for i, w in enumerate(words)}
    own: list[list[tuple[int, int]]] = [[] for _ in names]
    for q, w, n in sorted(rows):
        own[at[q]].append((word[w], n))
    slots = []
    for k in range(max(map(len, own), default=0)):
        some = [(q, *ws[k]) for q, ws in enumerate(own) if len(ws) > k]
        slots.append(tuple(np.array(c) for c in zip(*some)))
    return Asked(names, words, slots)


def score(ask: Asked, ids: pa.Array, doc: np.ndarray, word: np.ndarray, w: np.ndarray, pr: np.ndarray) -> Scores:
    n = len(ids)
    weight, held = np.zeros((len(ask.words), n)), np.zeros((len(ask.words), n), bool)
    np.add.at(weight, (word, doc), w)  # an id may have several postings of a word
    held[word, doc] = True
    rank = np.full(n, -np.inf)
    np.maximum.at(rank, doc, pr)
    lex, hit = np.zeros((len(ask.names), n)), np.zeros((len(ask.names), n), bool)
    for queries, words, times in ask.slots:
        lex[queries] += weight[words] * times[:, None]
        hit[queries] |= held[words]
    return Scores(ids, rank, lex, hit, held)


def tables_by(batches: Iterator[pa.RecordBatch], key: str, many: int) -> Iterator[pa.Table]:
    """Rows that are sorted by ``key``, ``many`` keys at a time (the last: fewer), each with all its rows."""

    def cut(table: pa.Table, last: bool) -> Iterator[pa.Table]:
        coded = pc.dictionary_encode(table.column(key).combine_chunks())
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        whole = n if last else n - 1  # the last key may go on in the next batch
        lo = 0
        while lo < whole and (last or whole - lo >= many):
            up = min(lo + many, whole)
            a, b = np.searchsorted(code, [lo, up])
            yield table.slice(a, b - a)
            lo = up
        yield table.slice(int(np.searchsorted(code, lo)))

    rest, rows = [], 0
    for batch in batches:
        rest.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= many:
            *done, left = cut(pa.concat_tables(rest), False)
            yield from done
            rest, rows = [left], 0
    if rest:
        yield from list(cut(pa.concat_tables(rest), True))[:-1]


def scored_parts(batches: Iterator[pa.RecordBatch], ask: Asked) -> Iterator[Scores]:
    """The documents of postings that are sorted by id, some at a time."""
    for table in tables_by(batches, "id", max(1, min(DOCS, CELLS // max(1, len(ask.words), len(ask.names))))):
        coded = pc.dictionary_encode(table.column("id").combine_chunks())
        word, w, pr = (table.column(c).to_numpy() for c in ("word", "w", "pr"))
        yield score(ask, coded.dictionary, coded.indices.to_numpy(), word, w, pr)


class Matches:
    """The matches of ``queries`` (``query_id, query``) in a BM25 index."""

    def __init__(self, queries: DataFrame, index: Bm25Index):
        self.queries, self.index = queries, index
        rows = query_terms(queries).select("query_id", "term", "qtf").limit(SMALL_ROWS + 1).collect()
        self.ask = asked([tuple(r) for r in rows if r[0] is not None]) if len(rows) <= SMALL_ROWS else None

    @property
    def small(self) -> bool:
        """Whether the words go to the tasks."""
        return self.ask is not None

    def frame(self) -> DataFrame:
        return bm25_scores(self.queries, self.index)

    def words(self) -> DataFrame:
        words = self.queries.sparkSession.createDataFrame([(t, i) for i, t in enumerate(self.ask.words)], "term string, word int")
        return F.broadcast(words)

    def tasks(self) -> int:
        """How many tasks all postings of the queries' words are worth."""
        total = self.index.vocab.join(self.words(), "term").agg(F.sum("df")).first()[0] or 0
        return max(shuffle_partitions(self.queries.sparkSession), -(-int(total) // TASK_ROWS))

    def run(self, kernel: Callable[[Iterator[Scores], Asked], Iterator[pa.RecordBatch]], schema: str, postings: DataFrame | None = None) -> DataFrame:
        """``kernel`` in each task, on the scores of all its documents. ``postings`` (``term, id, w, pr``) stand for
        the index's own; their ids may be blocks."""
        rows = (self.index.postings if postings is None else postings).join(self.words(), "term").select("id", "word", "w", "pr")
        rows = rows.repartition(self.tasks(), "id").sortWithinPartitions("id")
        sent = self.queries.sparkSession.sparkContext.broadcast(self.ask)
        return rows.mapInArrow(lambda batches: kernel(scored_parts(batches, sent.value), sent.value), schema)


# --- kernels of searches by block bounds ------------------------------------------------------------

def leading(alpha: float, first: int) -> Callable[[Iterator[Scores], Asked], Iterator[pa.RecordBatch]]:
    """``query_id, block, bound``: a task's ``first`` blocks of each query by their bounds."""

    def kernel(parts: Iterator[Scores], ask: Asked) -> Iterator[pa.RecordBatch]:
        best, block = np.full((len(ask.names), first), -np.inf), np.zeros((len(ask.names), first), np.int64)
        for part in parts:
            ids = np.asarray(part.ids)
            bound = np.where(part.hit, alpha * part.lex + (1.0 - alpha) * part.pr, -np.inf)
            best = np.concatenate([best, bound], 1)
            block = np.concatenate([block, np.broadcast_to(ids, bound.shape)], 1)
            take = np.argpartition(-best, first - 1, axis=1)[:, :first]
            best, block = np.take_along_axis(best, take, 1), np.take_along_axis(block, take, 1)
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array([ask.names[i] for i in q], pa.string()), pa.array(block[q, at]), pa.array(best[q, at])], names=["query_id", "block", "bound"])

    return kernel


def reaching(alpha: float, needed: np.ndarray) -> Callable[[Iterator[Scores], Asked], Iterator[pa.RecordBatch]]:
    """``term, block``: words of queries in the blocks whose bound reaches what the query needs."""

    def kernel(parts: Iterator[Scores], ask: Asked) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = np.asarray(part.ids)
            open_ = part.hit & (alpha * part.lex + (1.0 - alpha) * part.pr >= needed[:, None])
            alive = np.zeros(part.held.shape, bool)
            for queries, words, _ in ask.slots:
                np.logical_or.at(alive, words, open_[queries])
            w, b = np.nonzero(alive & part.held)
            yield pa.RecordBatch.from_arrays([pa.array([ask.words[i] for i in w], pa.string()), pa.array(ids[b])], names=["term", "block"])

    return kernel


def topmost(alpha: float, needed: np.ndarray, n: int, slack: float) -> Callable[[Iterator[Scores], Asked], Iterator[pa.RecordBatch]]:
    """``query_id, id, lex, pr``: documents that score what the query needs, and what the task's ``n`` best so far do."""

    def kernel(parts: Iterator[Scores], ask: Asked) -> Iterator[pa.RecordBatch]:
        best, limit = np.full((len(ask.names), n), -np.inf), needed.copy()
        for part in parts:
            score_ = np.where(part.hit, alpha * part.lex + (1.0 - alpha) * part.pr, -np.inf)
            stay = part.hit & (score_ >= limit[:, None])
            some = np.flatnonzero(stay.any(1))
            if len(some):
                both = np.concatenate([best[some], score_[some]], 1)
                best[some] = -np.partition(-both, n - 1, axis=1)[:, :n]
                least = best[some].min(1)
                known = np.isfinite(least)
                limit[some[known]] = np.maximum(limit[some[known]], least[known] - np.abs(least[known]) * slack)
                stay &= score_ >= limit[:, None]
            q, d = np.nonzero(stay)
            yield pa.RecordBatch.from_arrays([pa.array([ask.names[i] for i in q], pa.string()), part.ids.take(pa.array(d)), pa.array(part.lex[q, d]), pa.array(part.pr[d])],
                                             names=["query_id", "id", "lex", "pr"])

    return kernel
