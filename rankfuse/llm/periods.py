"""Periodic runs of words: where a text repeats itself back to back, at any period.

A *run* is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal)
that holds the period at least ``TIMES`` times, has ``LEAST`` words or more, and that no neighbouring
word extends.

1. *Tiles.* Periods are dealt to octaves: 1 to 15, then ``[low, 2 * low)``. At the scale of an octave
   a text has a boundary at each multiple of ``step`` (16, then ``2 * low``) and around it a tile of
   ``step`` words before and ``2 * step`` after, so tiles overlap and any run of the octave holds
   a boundary together with the period behind it. The words half a step (at most the
   octave's least period) right or left of such a boundary then come again a period later: a tile
   in which no hash says so is empty and isn't sent. The others become rows of their own, dealt
   to all tasks by text, octave and place; so one very long text is not one task's work.
2. *Solving.* A tile is solved by itself: a Z-function from its boundary to the right and one to
   the left give for each period how far it holds, which is a fragment of a run; fragments
   whose period is a multiple of a shorter one are dropped.
3. *Stitching.* Fragments meet by text and period; those that overlap by a period or more are one run.

Work and rows sent grow with the words times the octaves in which a text is periodic. A text's
fragments and runs are never more than its words; a task holds one text, or ``FLUSH`` bytes of
tiles.

Nulls: a null text has no words; a null id is an id like others. Empty texts and texts of fewer than
``LEAST`` words have no runs. Very long texts are read by one task and solved by many. Ties among
a text's runs are ordered by start, then period. Repeated rows are separate rows with equal results.
Empty tables give empty results. Extra columns pass through ``collapse``; ones called like its
results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: A run holds its period this many times, and this many words.
TIMES = 3
LEAST = 24
#: Periods below this are one octave, with a boundary at each multiple of it.
FIRST = 16
#: Bytes of tiles or texts that a task gathers before it hands them on.
FLUSH = 4 << 20
#: Bytes of tiles that one task solves, about; and the most tasks that they are dealt to.
TASK_BYTES = 8 << 20
TASKS = 50_000

PIECE = ("file long, at long, doc_id long, n_words long, whole_sha256 string, body binary, "
         "low int, boundary long, begin long, ids binary")
FRAGMENT = "file long, at long, period long, begin long, end long"
RUN = "array<struct<start: long, length: long, period: long>>"
U = np.uint64


def octaves(n: int) -> Iterator[tuple[int, int, int, int]]:
    """``low, high, step, probe`` of each octave whose periods a run in ``n`` words can have."""
    if n >= LEAST:
        yield 1, FIRST, FIRST, FIRST // 2
        low = FIRST
        while TIMES * low <= n:
            yield low, 2 * low, 2 * low, low
            low *= 2


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int32)


def doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``2 * size`` words from each place, from those of ``size`` words (odd: never 0)."""
    a, b = h[:-size], h[size:]
    x = (a ^ (a >> U(29))) * U(0x9E3779B97F4A7C15) + (b ^ (b >> U(32))) * U(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> U(31))) | U(1)


def live_tiles(ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``low, boundary, begin, end`` of each tile in which a run of its octave can be found.

    Exact but for hash collisions, which can only make a tile live that holds none. A run of
    length ``max(LEAST, TIMES * q)`` extends half a period's excess or more to one side of ``[m, m + q)``.
    """
    n = len(ids)
    if n < LEAST:
        return
    h, size = (ids.astype(U) + U(1)) * U(0xBF58476D1CE4E5B9) | U(1), 1
    for low, high, step, probe in octaves(n):
        while size < probe:
            h, size = doubled(h, size), size * 2
        boundary = np.arange(0, n, step)
        padded = np.zeros(boundary[-1] + probe + high + step, U)  # 0 is no hash: it equals nothing
        padded[probe : probe + len(h)] = h
        later = np.lib.stride_tricks.sliding_window_view(padded[low:], high - low)
        right, left = padded[probe + boundary], padded[boundary]
        live = ((later[probe + boundary] == right[:, None]).any(1) & (right > 0)) | ((later[boundary] == left[:, None]).any(1) & (left > 0))
        for m in boundary[live].tolist():
            yield low, m, max(0, m - step), min(n, m + 2 * step)


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` from there and ``s``."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = up = 0
    for i in range(1, n):
        k = min(up - i, z[i - lo]) if i < up else 0
        if i + k >= up:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            lo, up = i, i + k
        z[i] = k
    return z


@functools.lru_cache(maxsize=1 << 16)
def prime_factors(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return (*out, q) if q > 1 else tuple(out)


def fragments(words: list[int], low: int, at: int, first: bool, last: bool) -> Iterator[tuple[int, int, int]]:
    """``period, begin, end`` (places in the tile) of the parts of runs around the boundary ``at``.

    ``first`` and ``last``: the tile begins or ends with its text. Parts that are cut off by an
    end of the tile which isn't the text's are given whatever their length; others if they are runs.
    """
    high = FIRST if low == 1 else 2 * low
    n = len(words)
    most = min(high - 1, n - at)
    if most < low:
        return
    ahead = z_function(words[at:]) + [0]
    before, both = words[:at][::-1], words[: at + most][::-1]
    behind = z_function([*before, -1, *both])[len(before) + 1 :]
    q = np.arange(low, most + 1)
    right = np.array(ahead)[q]
    left = np.array([*behind, 0])[most - q]
    whole = left + right >= np.maximum(LEAST - q, (TIMES - 1) * q)
    cut = (not first) & (left == at) | (not last) & (right == n - at - q)
    for k in np.flatnonzero(whole | cut).tolist():
        p = low + k
        if all(ahead[p // f] < p - p // f for f in prime_factors(p)):
            yield p, at - int(left[k]), at + p + int(right[k])


def cut_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its row and the rows of its live tiles. The words go along only if there are any."""
    names = [f.split()[0] for f in PIECE.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for i in range(batch.num_rows):
            file, at, doc, text = (batch.column(k)[i].as_py() for k in range(4))
            words = (text or "").encode().split()
            n, body, tiles = len(words), b" ".join(words), 0
            if n >= LEAST:
                ids = numbered(words)
                for low, boundary, begin, end in live_tiles(ids):
                    rows.append((file, at, None, n, None, None, low, boundary, begin, ids[begin:end].tobytes()))
                    tiles, held = tiles + 1, held + 4 * (end - begin) + 64
                    if held >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
            rows.append((file, at, doc, n, None if tiles else hashlib.sha256(body).hexdigest(), body if tiles else None, None, None, None, None))
            held += 128 + (len(body) if tiles else 0)
            if held >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, ...]] = []
        for file, at, n, low, boundary, begin, ids in zip(*(batch.column(k) for k in range(7))):
            words, begin, m = np.frombuffer(ids.as_buffer(), np.int32).tolist(), begin.as_py(), boundary.as_py()
            for q, lo, up in fragments(words, low.as_py(), m - begin, begin == 0, begin + len(words) == n.as_py()):
                out.append((file.as_py(), at.as_py(), q, begin + lo, begin + up))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["file", "at", "period", "begin", "end"])


def stitched(parts: DataFrame) -> DataFrame:
    """``file, at, start, length, period``: the runs that fragments make up.

    Two stretches of one period are one stretch of it if they overlap by the period. A text has
    a fragment of a period for each boundary at most, so a group is small against its text.
    """
    key = ("file", "at", "period")
    parts = parts.groupBy(*key, "begin").agg(F.max("end").alias("end"))
    earlier = W.partitionBy(*key).orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("end").over(earlier)
    parts = parts.withColumn("opens", (reach.isNull() | (F.col("begin") > reach - F.col("period"))).cast("int"))
    so_far = W.partitionBy(*key).orderBy("begin").rowsBetween(W.unboundedPreceding, 0)
    runs = parts.withColumn("run", F.sum("opens").over(so_far)).groupBy(*key, "run").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    runs = runs.select("file", "at", "start", (F.col("end") - F.col("start")).alias("length"), "period")
    return runs.where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period")))


def kept_words(body: bytes, runs: list[dict]) -> bytes:
    """The words of ``body`` that no run holds after its first period, joined by one space."""
    words = body.split()
    stay = np.ones(len(words), bool)
    for r in runs:
        stay[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def collapsed(body: Column, runs: Column) -> Column:
    """The words of ``body`` less what its ``runs`` repeat (binary; null if there is no body)."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, lists in batches:
            for lo in range(0, len(bodies), 256):
                pairs = zip(bodies.slice(lo, 256).to_pylist(), lists.slice(lo, 256).to_pylist())
                yield pa.array([None if b is None else kept_words(b, rs or []) for b, rs in pairs], pa.binary())

    return run(body, runs)


def find(rows: DataFrame) -> DataFrame:
    """One row for each of ``rows`` (``file, at, doc_id, text``): ``file, at, doc_id, n_words, runs,
    whole_sha256, body``.

    ``runs`` (never null) come by start, then period. Texts that are nowhere near periodic carry the
    digest of their words, joined by one space, and no ``body``; the others their words.
    """
    common.prepare(rows.sparkSession)
    pieces = common.stage(rows.select("file", "at", "doc_id", "text").mapInArrow(cut_tiles, PIECE), "tiles")
    tiles = pieces.where(F.col("low").isNotNull()).select("file", "at", "n_words", "low", "boundary", "begin", "ids")
    held = tiles.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    tasks = min(TASKS, 1 + held // TASK_BYTES)
    parts = tiles.repartition(tasks, "file", "at", "low", "boundary").mapInArrow(solve_tiles, FRAGMENT)
    runs = stitched(parts).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    texts = pieces.where(F.col("low").isNull()).select("file", "at", "doc_id", "n_words", "whole_sha256", "body")
    some = texts.where(F.col("body").isNotNull()).join(runs, ["file", "at"], "left")
    none = texts.where(F.col("body").isNull()).withColumn("runs", F.lit(None).cast(RUN))
    both = some.unionByName(none)
    return both.withColumn("runs", F.coalesce("runs", F.array().cast(RUN)))


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less what its runs repeat, words joined by one space (null stays null), and
    the columns ``n_words`` and ``runs`` (existing ones of these names are replaced)."""
    common.prepare(docs.sparkSession)
    row, new = common.fresh(docs, "row", "new")
    rows = common.located(docs, row)
    found = find(rows.select(f"{row}.file", f"{row}.at", F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    found = found.select(F.struct("file", "at").alias(row), F.struct("n_words", "runs").alias(new))
    clean = common.without(rows, *[c for c in ("n_words", "runs") if c != text])
    both = clean.join(found, row)
    short = collapsed(F.col(f"`{text}`").cast("binary"), F.col(new)["runs"]).cast("string").alias(text)
    keep = [c for c in clean.columns if c != row]
    return both.select(*[short if c == text else F.col(f"`{c}`") for c in keep], f"{new}.n_words", f"{new}.runs")


# --- the query ------------------------------------------------------------------------------------

def planted(words: list[bytes], h: int) -> list[bytes]:
    """The query's input: some texts (by the hash of their id) are made periodic from a place on."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def with_tail(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, hashes in batches:
        for lo in range(0, len(texts), 256):
            pairs = zip(texts.slice(lo, 256).to_pylist(), hashes.slice(lo, 256).to_pylist())
            yield pa.array([t if t is None or h is None or h % 10 else b" ".join(planted(t.encode().split(), h)).decode() for t, h in pairs], pa.string())


DIGEST = "struct<n_runs: long, start: long, length: long, period: long, exponent_milli: long, runs_sha256: string, collapsed_sha256: string>"


def digest(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    types = [pa.int64()] * 5 + [pa.string()] * 2
    for columns in batches:
        for lo in range(0, len(columns[0]), 256):
            out = []
            for body, whole, runs in zip(*(c.slice(lo, 256).to_pylist() for c in columns)):
                best = None
                for r in runs:  # by start, then period: only a greater quotient replaces the best
                    if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                        best = r
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                first = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                kept = whole if body is None else hashlib.sha256(kept_words(body, runs)).hexdigest()
                out.append((len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), kept))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_runs``, the run with the greatest length / period (``start,
    length, period, exponent_milli``; null without runs), ``runs_sha256, collapsed_sha256``."""
    common.prepare(docs.sparkSession)
    rows = common.located(docs.select("doc_id", "text"), "row")
    text = F.arrow_udf(with_tail, "string")(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text")
    found = find(rows.select("row.file", "row.at", "doc_id", text))
    out = found.select("doc_id", F.arrow_udf(digest, DIGEST)("body", "whole_sha256", "runs").alias("d"))
    return out.select("doc_id", "d.*")
