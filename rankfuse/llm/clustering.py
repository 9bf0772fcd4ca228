"""Lloyd's clustering around centroids, exact, with bounds that moved centroids loosen by geometry.

Vectors are integers, centroids the exact floors of their means, so results are the same whatever
the order of work. Each vector carries its cluster, an upper bound of the distance to its centroid
and a lower bound of the distance to any other one. While the first is below the second (or
below half the way to the next centroid) the vector stays without a look at the centroids. Else
its own distance is computed, and if that doesn't settle it, the vector is *ambiguous* and all
centroids are scanned in integers.

*Drift tightening.* When centroids move, the upper bound grows by the drift of the vector's own one.
The lower bound needn't shrink by the largest drift of the others: a cluster's vectors lie in a
sphere around its old centroid. Let another centroid move from ``c`` to ``c'``. In the plane through
both and the sphere's centre, places that come nearer by ``v`` or more lie within a branch of a
hyperbola with foci ``c`` and ``c'``, and so within its asymptotes' cone, which opens at their midpoint
with a half angle of ``arccos(v / |c - c'|)``. A sphere seen from the midpoint at an angle
``phi`` off the axis, with a half width of ``arcsin(r / h)``, so comes nearer by ``|c - c'| * cos(phi -
arcsin(r / h))`` at most, by nothing if that is negative, and only by the whole drift if the cone's
axis or the midpoint is in the sphere. The largest of these over the other centroids is the
cluster's loosening.

A round is one pass over the vectors (a table in the shared folder, written with new bounds, the
last one removed) without any shuffle of vectors; each batch adds its sums to a few rows beside them.
The driver sees ``k`` centroids, their sums and radii: fixed by the parameters.

Nulls: a null vector, or one with null or non-finite components or another length, takes no part;
a vector with a null id does, but starts no centroid unless all ids are null. Ties: equal distances
go to the smaller number, starts with equal hashes to the smaller vector. Repeated rows are separate
vectors. Fewer vectors than ``k`` give as many centroids; an empty table gives an empty result.
Components beyond ``LARGEST`` are an error, as their squared distances need not fit a long. Extra
columns don't come through: the result has the id and what the clustering says about it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Squares of differences of such components, summed over 2^6 of them, fit a long.
LARGEST = 1 << 27
#: Products of smaller ones are exact in doubles.
SMALL = 1 << 22
#: Bounds are doubles: this much of them (and as much beside) is never trusted.
SLACK = 1e-9
#: Rows that are scanned together.
SCAN_ROWS = 4096

STATE = ("vec_id long, v array<long>, cluster int, upper double, lower double, distance long, "
         "sums array<long>, n long, radius double, settled long, scanned long")
NAMES = [f.split()[0] for f in STATE.split(", ")]


@dataclass
class Clustering:
    """``assigned``: ``vec_id, cluster, distance`` (squared). ``centroids`` are those that it was assigned to,
    ``inertia`` the summed distances of each, ``work`` a dict of counts for each pass."""

    assigned: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    work: list[dict] = field(default_factory=list)


def usable(vector: Column, size: int) -> Column:
    """Exactly ``size`` components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors x centroids)."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < SMALL:
        x, c = vectors.astype(float), centroids.astype(float)
        out = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        return out.astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster how much nearer any other centroid can have come to a vector of it."""
    k = len(old)
    move = (new - old).astype(float)
    drift = np.sqrt((move**2).sum(1))
    middle = (new + old) / 2.0
    out = np.zeros(k)
    for j in range(k):
        if drift[j] == 0:
            continue
        off = old - middle[j]
        far = np.sqrt((off**2).sum(1))
        inside = far <= radius * (1 + SLACK) + SLACK
        h = np.where(inside, 1.0, far)
        phi = np.arccos(np.clip((off @ move[j]) / (h * drift[j]), -1, 1))
        theta = phi - np.arcsin(np.clip(radius / h, 0, 1)) - SLACK
        nearer = np.where(inside, drift[j], drift[j] * np.clip(np.cos(np.maximum(theta, 0)), 0, 1))
        nearer[j] = 0
        out = np.maximum(out, nearer)
    return out * (1 + SLACK)


@dataclass
class Step:
    """What a pass needs: the centroids now and, after the first pass, how they moved."""

    centroids: np.ndarray
    drift: np.ndarray | None = None
    loosen: np.ndarray | None = None

    @staticmethod
    def after(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Step:
        drift = np.sqrt(((new - old).astype(float) ** 2).sum(1)) * (1 + SLACK)
        return Step(new, drift, loosening(old, new, radius))

    def half_gap(self) -> np.ndarray:
        """Half the distance from each centroid to the next one."""
        if len(self.centroids) < 2:
            return np.full(len(self.centroids), np.inf)
        gap = np.sqrt(squared(self.centroids, self.centroids).astype(float))
        np.fill_diagonal(gap, np.inf)
        return gap.min(1) / 2

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """New ``cluster, upper, lower``, and how many vectors bounds settled and how many were scanned."""
        if self.drift is None:
            open_ = np.arange(len(v))
            cluster, upper, lower = np.zeros(len(v), np.int64), np.zeros(len(v)), np.zeros(len(v))
        else:
            upper, lower = upper + self.drift[cluster], np.maximum(lower - self.loosen[cluster], 0)
            bound = np.maximum(lower, self.half_gap()[cluster])
            open_ = np.flatnonzero(~(upper * (1 + SLACK) + SLACK < bound))
            own = v[open_] - self.centroids[cluster[open_]]
            upper[open_] = np.sqrt((own * own).sum(1).astype(float)) * (1 + SLACK)
            open_ = open_[~(upper[open_] * (1 + SLACK) + SLACK < bound[open_])]
        for lo in range(0, len(open_), SCAN_ROWS):
            at = open_[lo : lo + SCAN_ROWS]
            d = squared(v[at], self.centroids)
            best = d.argmin(1)  # the first of equal ones
            upper[at] = np.sqrt(d[np.arange(len(at)), best].astype(float)) * (1 + SLACK)
            cluster[at] = best
            d[np.arange(len(at)), best] = np.iinfo(np.int64).max
            lower[at] = np.sqrt(d.min(1).astype(float)) * (1 - SLACK) if d.shape[1] > 1 else np.inf
        return cluster, upper, lower, len(v) - len(open_), len(open_)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def one_pass(table: DataFrame, step: Step, last: bool) -> DataFrame:
    """``table`` with new clusters and bounds (at the last pass with distances instead of vectors), and
    for each batch and cluster a row of its vectors' sums, number, radius and work."""
    sent = table.sparkSession.sparkContext.broadcast(step)
    width = step.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        k = len(now.centroids)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = matrix(batch.column(1), width)
            state = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in (2, 3, 4)]
            cluster, upper, lower, settled, scanned = now.assign(v, *state)
            own = v - now.centroids[cluster]
            distance = (own * own).sum(1)
            none = lambda t, m: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), none(pa.list_(pa.int64()), n) if last else batch.column(1), pa.array(cluster, pa.int32()),
                pa.array(upper), pa.array(lower), pa.array(distance), none(pa.list_(pa.int64()), n), *[none(t, n) for t in (pa.int64(), pa.float64(), pa.int64(), pa.int64())],
            ], names=NAMES)
            sums, count, radius, inertia = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k, np.int64)
            np.add.at(sums, cluster, v)
            np.add.at(count, cluster, 1)
            np.maximum.at(radius, cluster, upper)
            np.add.at(inertia, cluster, distance)
            some = np.flatnonzero(count)
            m = len(some)
            work = np.zeros((2, m), np.int64)
            work[:, 0] = settled, scanned
            yield pa.RecordBatch.from_arrays([
                none(pa.int64(), m), none(pa.list_(pa.int64()), m), pa.array(some, pa.int32()), none(pa.float64(), m), none(pa.float64(), m),
                pa.array(inertia[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(count[some]), pa.array(radius[some]),
                pa.array(work[0]), pa.array(work[1]),
            ], names=NAMES)

    return table.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, STATE)


def summed(state: DataFrame, k: int, width: int) -> tuple[list[list[int]], list[int], np.ndarray, list[int], dict]:
    """Sums, numbers, radii and summed distances of the clusters, and the work of a pass: ``k`` times
    ``width`` rows. Sums are decimals, as longs could overflow."""
    parts = state.where(F.col("n").isNotNull())
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    facts = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), wide("distance").alias("inertia"),
        F.sum("settled").alias("settled"), F.sum("scanned").alias("scanned")).collect()
    each = parts.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(wide("x").alias("x")).collect()
    sums, counts, radius, inertia = [[0] * width for _ in range(k)], [0] * k, np.zeros(k), [0] * k
    for r in each:
        sums[r["cluster"]][r["i"]] = int(r["x"])
    for r in facts:
        counts[r["cluster"]], radius[r["cluster"]], inertia[r["cluster"]] = r["n"], r["radius"], int(r["inertia"])
    return sums, counts, radius, inertia, {w: sum(r[w] for r in facts) for w in ("settled", "scanned")}


def cluster(vectors: DataFrame, start_key: Column, k: int, rounds: int) -> Clustering:
    """``vectors`` (``vec_id, v``: array<long> of one length) around ``k`` centroids after ``rounds`` moves.

    They start as the ``k`` vectors with the smallest ``start_key`` (an expression over ``vec_id``).
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("upper", "double"), ("lower", "double"))]
    state = common.stage(vectors.select("vec_id", "v"), "vectors")
    starts = state.orderBy(start_key.asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, 0), np.int64), [])
    centroids = np.array([r["v"] for r in starts], np.int64)
    most = state.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    if most is not None and most > LARGEST:
        raise ValueError(f"components up to {most}: squared distances may not fit a long beyond {LARGEST}")
    step, work, width = Step(centroids), [], centroids.shape[1]
    table = state.select("vec_id", "v", *none)
    for t in range(rounds + 1):
        after = common.stage(one_pass(table, step, t == rounds), f"clusters-{t}")
        common.unstage(state)
        state = after
        table = state.where(F.col("n").isNull())
        sums, counts, radius, inertia, done = summed(state, len(centroids), width)
        work.append(done)
        if t < rounds:
            moved = np.array([[x // n for x in xs] if n else c for xs, n, c in zip(sums, counts, centroids.tolist())], np.int64)
            step, centroids = Step.after(centroids, moved, radius), moved
    return Clustering(table.select("vec_id", "cluster", "distance"), centroids, inertia, work)


def digests(embeddings: DataFrame, k: int, rounds: int, size: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """One row per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    known = embeddings.where(usable(F.col("embedding"), size)).select("vec_id", scaled(F.col("embedding"), scale).alias("v"))
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    got = cluster(known, key, k, rounds)
    spark = embeddings.sparkSession
    rows = [(j, got.inertia[j], sum(got.inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(got.centroids.tolist())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int, rounds: int) -> str:
    """The same by scanning everything in each round (DuckDB)."""
    far = "(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v))::BIGINT"
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, [floor(256 * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept "
        f"QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) <= {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT x.r, x.vec_id, x.v, c.c, {far} AS d FROM kept x, c{t} c "
                     f"QUALIFY row_number() OVER (PARTITION BY x.r ORDER BY {far}, c.c) = 1)")
        if t < rounds:
            parts.append(f"s{t} AS (SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS i FROM a{t}) GROUP BY c, i)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{t} GROUP BY c "
                         f"UNION ALL SELECT c, v FROM c{t} ANTI JOIN s{t} USING (c))")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} f USING (c)")
