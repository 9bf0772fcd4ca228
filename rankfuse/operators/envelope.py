"""Top-n for all blend weights at once.

A document's score ``alpha * lex + (1 - alpha) * pr`` is a line over alpha. Of all the lines of a query
only few are ever among the ``n`` highest at one of the grid's alphas; this module finds them without
a row for each document and alpha. Wherever some of a query's documents are together they can be
cut down to those: what isn't among the best ``n`` of a part is not among those of the whole. So:

1. each task cuts the documents it happens to hold, query by query (no shuffle, like a partial
   aggregation); of ``Matches`` right where it scores them (``leading_lines``);
2. what is left meets by query and is cut again, ``CUT_ROWS`` at a time, so that memory is bounded by
   that and by grid times ``n``, however many documents match;
3. the result sets, or the differences of all pairs of them, are made of the rest in the same task.

Keys are the scores' leading bits, ties go to smaller ids, as in ``search.result_order``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matches import Asked, Matches, Scores
from .ordering import SPLITTER

#: Rows of a query that are cut together.
CUT_ROWS = 50_000


def keys(lex: np.ndarray, pr: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores at one alpha, and their order keys (see ``ordering.significant``)."""
    score = alpha * lex + (1.0 - alpha) * pr
    wide = score * SPLITTER
    return score, wide - (wide - score)


def best(lex: np.ndarray, pr: np.ndarray, alphas: Sequence[float], n: int) -> list[np.ndarray]:
    """For each alpha the places of the ``n`` best, best first; rows must stand in order of their ids."""
    out = []
    for a in alphas:
        key = keys(lex, pr, a)[1]
        some = np.arange(len(key))
        if len(key) > n:
            some = np.flatnonzero(key >= np.partition(key, len(key) - n)[len(key) - n])
        out.append(some[np.argsort(-key[some], kind="stable")[:n]])
    return out


class Lines:
    """The documents of one query that are left so far."""

    def __init__(self, alphas: Sequence[float], n: int):
        self.alphas, self.n = alphas, n
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, part: pa.Table) -> None:
        self.parts.append(part)
        self.rows += part.num_rows
        if self.rows > CUT_ROWS:
            self.cut()
            # what stays can be many rows of a large grid: don't cut these again for each small part
            self.rows = 0

    def ordered(self) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.concat_tables(self.parts)
        table = table.take(pc.sort_indices(table.column("id")))
        return table, table.column("lex").to_numpy(), table.column("pr").to_numpy()

    def cut(self) -> pa.Table:
        table, lex, pr = self.ordered()
        if table.num_rows > self.n:
            stay = np.unique(np.concatenate(best(lex, pr, self.alphas, self.n)))
            table = table.take(pa.array(stay))
        self.parts = [table]
        return table


def by_query(batches: Iterator[pa.RecordBatch], alphas: Sequence[float], n: int) -> Iterator[tuple[str, Lines]]:
    """Runs of one query (rows must be sorted by it); rows without an id only name the query."""
    query, lines = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = table.column("query_id").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for lo, up in zip(edges, edges[1:]):
            if lo == up:
                continue
            if lines is None or names[lo] != query:
                if lines is not None:
                    yield query, lines
                query, lines = names[lo], Lines(alphas, n)
            part = table.slice(lo, up - lo).select(["id", "lex", "pr"])
            lines.add(part.filter(pc.is_valid(part.column("id"))))
    if lines is not None:
        yield query, lines


SCORED = "query_id string, id string, lex double, pr double"


#: Parts that the grid is cut into for a first look at documents.
SPANS = 8


class Leaders:
    """One query's lines of a task that are left so far, as arrays; ``low``: what a line must reach somewhere in each span."""

    def __init__(self, alphas: Sequence[float], n: int, spans: list[tuple[int, int]]):
        self.alphas, self.n, self.spans = alphas, n, spans
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.low = np.full(len(spans), -np.inf)
        self.rows, self.limit = 0, 4 * n

    def add(self, doc: np.ndarray, lex: np.ndarray, pr: np.ndarray) -> None:
        self.parts.append((doc, lex, pr))
        self.rows += len(doc)
        if self.rows > self.limit:
            self.cut()
            self.limit = 2 * self.rows + 4 * self.n

    def cut(self) -> tuple[np.ndarray, ...]:
        doc, lex, pr = (np.concatenate(c) for c in zip(*self.parts))
        if len(doc) > self.n:
            sets = best(lex, pr, self.alphas, self.n)
            last = np.array([keys(lex[s[-1:]], pr[s[-1:]], a)[1][0] for a, s in zip(self.alphas, sets)])
            self.low = np.array([last[i : j + 1].min() for i, j in self.spans])
            stay = np.unique(np.concatenate(sets))
            doc, lex, pr = doc[stay], lex[stay], pr[stay]
        self.parts, self.rows = [(doc, lex, pr)], len(doc)
        return doc, lex, pr


def leading_lines(matches: Matches, alphas: Sequence[float], n: int) -> DataFrame:
    """``survivors`` of all matches, straight from the index: no row for each query and document.

    A line is highest over a span of alphas at one of its ends, so a document that reaches at neither end
    of any span what the ``n`` best so far have at the least there is in no result set."""
    grid = sorted(float(a) for a in alphas)
    knots = sorted({round(k * (len(grid) - 1) / SPANS) for k in range(SPANS + 1)})
    spans = list(zip(knots, knots[1:])) or [(0, 0)]

    def kernel(parts: Iterator[Scores], ask: Asked) -> Iterator[pa.RecordBatch]:
        left: dict[int, Leaders] = {}
        low = np.full((len(ask.names), len(spans)), -np.inf)
        ids, count = [], 0
        for part in parts:
            keep = np.zeros_like(part.hit)
            ends = [grid[k] * part.lex + (1.0 - grid[k]) * part.pr for k in knots]
            for j, (a, b) in enumerate(zip(ends, ends[1:] or ends)):
                top = np.maximum(a, b)
                keep |= top + np.abs(top) * 1e-8 >= low[:, j, None]
            queries, docs = np.nonzero(keep & part.hit)
            edges = np.flatnonzero(np.diff(queries, prepend=-1, append=-1))
            for lo, up in zip(edges, edges[1:]):
                q, d = int(queries[lo]), docs[lo:up]
                lines = left.setdefault(q, Leaders(grid, n, spans))
                lines.add(count + d, part.lex[q, d], part.pr[d])
                low[q] = lines.low
            ids.append(part.ids)
            count += len(part.ids)
        known = pa.concat_arrays(ids) if ids else None
        for q, lines in sorted(left.items()):
            doc, lex, pr = lines.cut()
            yield pa.RecordBatch.from_arrays([pa.array([ask.names[q]] * len(doc), pa.string()), known.take(pa.array(doc)).cast(pa.string()), pa.array(lex), pa.array(pr)],
                                             names=["query_id", "id", "lex", "pr"])

    return matches.run(kernel, SCORED)


def survivors(scored: DataFrame | Matches, alphas: Sequence[float], n: int) -> DataFrame:
    """``scored`` (``query_id, id, lex, pr``) less what its task alone shows to be in no result set."""
    alphas = [float(a) for a in alphas]
    if isinstance(scored, Matches):
        if scored.small:
            return leading_lines(scored, alphas, n)
        scored = scored.frame()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, lines in by_query(batches, alphas, n):
            table = lines.cut()
            if table.num_rows:
                names = pa.array([query] * table.num_rows, pa.string())
                yield from pa.table({"query_id": names, **{c: table.column(c) for c in ("id", "lex", "pr")}}).to_batches()

    rows = scored.select(F.col("query_id").cast("string"), F.col("id").cast("string"), F.col("lex").cast("double"), F.col("pr").cast("double"))
    return rows.where(F.col("id").isNotNull() & F.col("lex").isNotNull() & F.col("pr").isNotNull()).sortWithinPartitions("query_id").mapInArrow(run, SCORED)


def _per_query(scored: DataFrame | Matches, queries: DataFrame | None, alphas: Sequence[float], n: int, schema: str,
               make: Callable[[str, pa.Table, np.ndarray, np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Runs ``make`` on the lines and result sets of each query; with ``queries`` also on those without any."""
    alphas = [float(a) for a in alphas]
    rows = survivors(scored, alphas, n)
    if queries is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("lex", "double"), ("pr", "double"))]
        rows = rows.unionByName(queries.select(F.col("query_id").cast("string").alias("query_id"), *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, lines in by_query(batches, alphas, n):
            lines.cut()
            table, lex, pr = lines.ordered()
            yield from make(query, table, lex, pr, best(lex, pr, alphas, n))

    return rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, schema)


def top_for_all_alphas(scored: DataFrame | Matches, alphas: Sequence[float], n: int = 100) -> DataFrame:
    """``(query_id, alpha, pos, id, score, lex, pr)``: the result sets of every query at every alpha.

    The same rows as ``evaluate.alpha_sweep``."""
    grid = np.array([float(a) for a in alphas])

    def make(query, table, lex, pr, sets):
        sizes = [len(s) for s in sets]
        at = np.concatenate(sets) if sets else np.empty(0, int)
        if not len(at):
            return
        a = np.repeat(grid, sizes)
        pos = np.concatenate([np.arange(1, k + 1) for k in sizes])
        yield pa.RecordBatch.from_arrays([
            pa.array([query] * len(at), pa.string()), pa.array(a), pa.array(pos, pa.int64()), table.column("id").take(pa.array(at)).combine_chunks(),
            pa.array(a * lex[at] + (1.0 - a) * pr[at]), pa.array(lex[at]), pa.array(pr[at]),
        ], names=["query_id", "alpha", "pos", "id", "score", "lex", "pr"])

    return _per_query(scored, None, alphas, n, "query_id string, alpha double, pos long, id string, score double, lex double, pr double", make)


def differences_for_all_alphas(scored: DataFrame | Matches, queries: DataFrame, alphas: Sequence[float], n: int = 100) -> DataFrame:
    """``(query_id, alpha1, alpha2, difference)`` for every query and alpha pair a1 < a2: how much the result
    sets differ (``evaluate.resultset_diff``), without the sets as rows. Queries without a match differ
    by 0 everywhere.

    ``sum |s1 - s2| = S1 + S2 - 2 * sum over common documents of min(s1, s2)``, and the smaller score is that
    at the smaller alpha where ``lex >= pr``: two matrix products for all pairs of a query.
    """
    grid = np.array(sorted(float(a) for a in alphas))
    first, second = np.triu_indices(len(grid), 1)

    def make(query, table, lex, pr, sets):
        score, held = np.zeros((len(lex), len(grid))), np.zeros((len(lex), len(grid)))
        for j, (a, s) in enumerate(zip(grid, sets)):
            score[s, j], held[s, j] = a * lex[s] + (1.0 - a) * pr[s], 1.0
        up = lex >= pr
        common = score[up].T @ held[up] + held[~up].T @ score[~up]
        total = score.sum(0)
        both = total[first] + total[second]
        differ = np.where(both == 0, 0.0, (both - 2.0 * common[first, second]) / np.where(both == 0, 1.0, both))
        yield pa.RecordBatch.from_arrays([pa.array([query] * len(first), pa.string()), pa.array(grid[first]), pa.array(grid[second]), pa.array(differ)],
                                         names=["query_id", "alpha1", "alpha2", "difference"])

    return _per_query(scored, queries.select("query_id").distinct(), grid.tolist(), n,
                      "query_id string, alpha1 double, alpha2 double, difference double", make)
