"""Exact top-k inner products by norm-bucketed retrieval.

1. Vectors are range-partitioned by length, longest first, into *buckets* of about ``BUCKET_ROWS``
   (equal lengths are spread by a hash, so copies don't swell a bucket).
2. All queries meet the first bucket; its k-th best score is a query's first lower bound.
3. For each further bucket, a query goes there only if its length times the bucket's largest can
   reach the bound. The *local cosine threshold* (bound / (query length x largest length)) then
   chooses how candidates are pruned: from ``COORDINATE_FROM`` on by *coordinates* (with that angle
   to the query, a unit vector's coordinate can only lie in a certain interval, and the candidates are
   cut from the bucket's sorted list of the most telling coordinate, then filtered on the next),
   below it by *length* (the front of the bucket, by length).
4. Products of the survivors are computed in integers and the best k of each cell are kept; a
   window over at most k rows for each query and bucket ranks them.

A cell is one bucket and one block of ``QUERY_BLOCK`` queries. A task holds the vectors of one cell;
its queries stream past them by Arrow batches, so a block can be large: vectors travel once for
each block of queries, a query once for each bucket it can reach. Bounds keep a slack of ``SLACK`` for rounding, so
pruning never loses a candidate that ties with the bound.

Nulls: vectors that are null, hold a null or non-finite component, or have a null id take no part.
Shorter vectors count as padded with zeros. Repeated rows are separate candidates (and
queries); a query's own row, not its id, is left out. Ties go to the smaller id, then to the
earlier row. A product beyond a long is an error, not a wrong score. Empty tables and no queries give empty results. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKET_ROWS = 8192
QUERY_BLOCK = 1 << 16
COORDINATE_FROM = 0.2
FOCUS = 4
SLACK = 1e-9
HIT = "query_row long, query_id long, row long, vec_id long, score long"


def scaled(embedding: Column, scale: float = 1024.0) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    lists = column.combine_chunks()
    ends = np.asarray(lists.offsets)
    sizes, flat = np.diff(ends), np.asarray(lists.values)[ends[0] : ends[-1]]
    width = max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Bucket:
    """The candidates of a cell, longest first, with the sorted lists of its coordinates."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        order = np.lexsort((rows, ids, -length))
        self.vectors, self.ids, self.rows, self.length = vectors[order], ids[order], rows[order], length[order]
        self.unit = self.vectors / np.where(self.length > 0, self.length, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.most = float(np.abs(vectors).max(initial=0))

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def by_length(self, bound: float, size: float) -> np.ndarray:
        """Candidates long enough to reach the bound."""
        return np.arange(np.searchsorted(-self.length, -(bound / size) * (1 - SLACK), "right"))

    def by_coordinates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Candidates whose telling coordinates can be at this cosine of the query."""
        angle = math.acos(min(1.0, cosine * (1 - SLACK)))
        spans = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = math.acos(max(-1.0, min(1.0, float(unit[f]))))
            low, high = math.cos(min(math.pi, own + angle)) - SLACK, math.cos(max(0.0, own - angle)) + SLACK
            values, order = self.sorted_list(int(f))
            a, b = np.searchsorted(values, low), np.searchsorted(values, high, "right")
            spans.append((b - a, int(f), low, high, order[a:b]))
        spans.sort(key=lambda s: s[:2])
        found = spans[0][4]
        for _, f, low, high, _ in spans[1:]:
            x = self.unit[found, f]
            found = found[(x >= low) & (x <= high)]
        return found

    def best(self, query: np.ndarray, row: int, bound: float | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the query's best k here, of those that reach the bound."""
        size = math.sqrt(float((query.astype(float) ** 2).sum()))
        if bound is None or bound <= 0 or size == 0:
            found = np.arange(len(self.ids))
        else:
            cosine = bound / (size * self.length[0]) if self.length[0] > 0 else math.inf
            if cosine * (1 - SLACK) > 1:
                return np.empty(0, int), np.empty(0, np.int64)
            if cosine >= COORDINATE_FROM:
                found = self.by_coordinates(query / size, cosine)
                found = found[self.length[found] >= bound / size * (1 - SLACK)]
            else:
                found = self.by_length(bound, size)
        found = found[self.rows[found] != row]
        if self.most * float(np.abs(query).max(initial=0)) * len(query) < 2**53:  # exact in doubles
            score = (self.vectors[found].astype(float) @ query.astype(float)).astype(np.int64)
        else:
            score = np.array([sum(int(a) * int(b) for a, b in zip(v, query)) for v in self.vectors[found]], np.int64)
        if len(found) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[score >= edge], score[score >= edge]
        order = np.lexsort((self.rows[found], self.ids[found], -score))[:k]
        return found[order], score[order]


def cell_search(k: int, width: int):
    """Over batches ordered by (block, bucket, asks): the vectors of a cell, then its queries, which pass one
    batch at a time."""

    def answers(bucket: Bucket, asked: pa.Table) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in ("query_row", "query_id", "row", "vec_id", "score")}
        q = matrix(asked.column("v"), width)
        for i, (row, vec, bound) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("row", "vec_id", "bound")))):
            at, score = bucket.best(q[i], row, bound, k)
            out["query_row"] += [row] * len(at)
            out["query_id"] += [vec] * len(at)
            out["row"] += bucket.rows[at].tolist()
            out["vec_id"] += bucket.ids[at].tolist()
            out["score"] += score.tolist()
        return pa.record_batch({n: pa.array(x, pa.int64()) for n, x in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, bucket = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "bucket", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                some = pa.Table.from_batches([batch.slice(start, end - start)])
                if cell != tuple(keys[start, :2]):
                    cell, parts, bucket = tuple(keys[start, :2]), [], None
                if not keys[start, 2]:
                    parts.append(some)
                    continue
                if bucket is None and parts:
                    held = pa.concat_tables(parts)
                    bucket = Bucket(matrix(held.column("v"), width), held.column("vec_id").to_numpy(), held.column("row").to_numpy())
                    parts = []
                if bucket is not None:
                    yield answers(bucket, some)

    return run


def in_cells(queries: DataFrame, candidates: DataFrame, k: int, width: int) -> DataFrame:
    """The best ``k`` of each query (``block, bucket, row, vec_id, v, bound``) among the candidates of its cell."""
    held = candidates.select("block", "bucket", F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    asked = queries.select("block", "bucket", F.lit(True).alias("asks"), "row", "vec_id", "v", "bound")
    both = held.unionByName(asked).repartition("block", "bucket").sortWithinPartitions("block", "bucket", "asks")
    return both.mapInArrow(cell_search(k, width), HIT)


def search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of ``vectors`` (``vec_id, v``: array<long>)
    for each of its rows where ``is_query`` (an expression over ``vec_id``)."""
    common.prepare(vectors.sparkSession)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = common.stage(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", length.alias("length")), "vectors")
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    buckets, blocks = max(1, -(-n // BUCKET_ROWS)), max(1, -(-n_queries // QUERY_BLOCK))
    dealt = rows.repartitionByRange(buckets, F.col("length").desc(), F.xxhash64("vec_id", "row"))
    dealt = common.stage(dealt.withColumn("bucket", F.spark_partition_id()), "buckets")
    queries = dealt.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int"))
    stats = dealt.groupBy("bucket").agg(F.max("length").alias("most"))
    first = stats.agg(F.min("bucket")).first()[0]
    if first is None:
        first = 0

    # the first bucket against every block of queries
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    front = dealt.where(F.col("bucket") == first).select("bucket", "row", "vec_id", "v", every_block)
    asked = queries.withColumn("bucket", F.lit(first)).withColumn("bound", F.lit(None).cast("double"))
    seeds = common.stage(in_cells(asked, front, k, width), "seeds")
    bounds = seeds.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("bound"))

    # the other buckets against the queries that can reach their bound there; the buckets' largest
    # lengths, one number for each BUCKET_ROWS vectors, are spread over the blocks of queries
    bounded = common.stage(queries.drop("bucket").join(bounds, queries.row == bounds.query_row, "left").drop("query_row"), "bounded")
    others = stats.where(F.col("bucket") != first).select("bucket", "most", every_block)
    reach = F.col("bound").isNull() | (F.col("bound") <= 0) | (F.col("length") * F.col("most") >= F.col("bound") * (1 - SLACK))
    sent = bounded.join(others, "block").where(reach).select("block", "bucket", "row", "vec_id", "v", "bound")
    cells = sent.select("block", "bucket").distinct()
    hits = in_cells(sent, dealt.join(cells, "bucket"), k, width)
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = seeds.unionByName(hits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def digests(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    known = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return search(known.select("vec_id", scaled(F.col("embedding")).alias("v")), F.col("vec_id") % every == 0, k)


ORACLE = """
WITH known AS (
  SELECT vec_id, row_number() OVER () AS row, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, q.row AS query_row, c.vec_id, c.row, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM known q JOIN known c ON q.row <> c.row WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
