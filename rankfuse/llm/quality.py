"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are covered by chunks of ``CHUNK`` bytes; each chunk also sees the first
``WIDTH - 1`` bytes of the next, so that chunks overlap and every window of ``WIDTH`` bytes is in
one. Learned filters over the (learned) byte embeddings run along a chunk, are rectified and
max-pooled to one value for each filter, and the chunks' values are combined, as their mean and
their maximum over the *whole* document, into one probability.

Training: Adam on the logistic loss, with gradients through the pooled positions only, on a
sample of at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of the id), held-out
ids left out. For training only, a document gives at most ``SAMPLE_CHUNKS`` chunks, evenly spaced.
The sample (at most ``SAMPLE_ROWS x SAMPLE_CHUNKS x (CHUNK + WIDTH)`` bytes) goes to the driver, the
model (some 1,500 numbers) to the executors. Scoring is narrow: no shuffle, whole texts, a
block of chunks in memory at a time.

Nulls: a null text is the empty text, which has one chunk of padding and so a score; a null id
counts as the empty string where its remainder is taken; null labels are not learned from.
Repeated rows score alike; a repeated label row weighs twice. Without labels, or with labels of one class, the score is
their smoothed share. Empty tables give empty results; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 256
WIDTH = 8
EMBED = 4
FILTERS = 16
#: Bounds of the training sample: labelled rows, and chunks of a text (32 KiB). Those in it are read whole;
#: labelled rows with longer texts are not in it. Scores are of whole texts of any length.
SAMPLE_ROWS = 4000
SAMPLE_CHUNKS = 128
#: Mini-batches, whatever the size of the sample.
STEPS = 500
BATCH = 64
RATE = 0.01
SEED = 7
FOLDS = 5
#: Chunks whose windows are in memory at a time (about 34 kB each).
BLOCK = 512


def chunked(data: bytes) -> np.ndarray:
    """The overlapping chunks of a text, one row each, padded with zero bytes."""
    n = max(1, -(-len(data) // CHUNK))
    flat = np.zeros(n * CHUNK + WIDTH - 1, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH - 1)[::CHUNK]


class Network:
    def __init__(self, share: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.share = share
        self.p = {
            "embed": f32(256, EMBED, scale=0.5),
            "filters": f32(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "mean": f32(FILTERS, scale=0.1),
            "max": f32(FILTERS, scale=0.1),
            "base": np.array([np.log(share / (1 - share))], np.float32),
        }

    def pooled(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled filter values of each chunk, and where each maximum is."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        at = np.empty((len(chunks), FILTERS), np.int64) if places else None
        for lo in range(0, len(chunks), BLOCK):
            part = chunks[lo : lo + BLOCK]
            seen = self.p["embed"][part].reshape(len(part), -1)
            windows = np.lib.stride_tricks.sliding_window_view(seen, WIDTH * EMBED, axis=1)[:, ::EMBED]
            z = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.p["filters"]
            z = z.reshape(len(part), CHUNK, FILTERS)
            if places:
                top = z.argmax(axis=1)
                at[lo : lo + BLOCK] = top
                best = np.take_along_axis(z, top[:, None], axis=1)[:, 0]
            else:
                best = z.max(axis=1)
            out[lo : lo + BLOCK] = np.maximum(best + self.p["bias"], 0)
        return out, at

    def combine(self, pooled: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.diff(np.append(starts, len(pooled)))[:, None]
        mean = np.add.reduceat(pooled, starts, axis=0, dtype=np.float64) / count
        most = np.maximum.reduceat(pooled, starts, axis=0)
        logit = mean @ self.p["mean"].astype(float) + most @ self.p["max"].astype(float) + float(self.p["base"][0])
        return mean, most, 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each text; blocks of chunks run across texts, so a long text is
        no larger in memory than many short ones."""
        total, most, count = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if size:
                pooled, _ = self.pooled(np.concatenate(held))
                who = np.concatenate(owner)
                starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                own = who[starts]
                total[own] += np.add.reduceat(pooled, starts, axis=0, dtype=np.float64)
                most[own] = np.maximum(most[own], np.maximum.reduceat(pooled, starts, axis=0))
                count[own] += np.diff(np.append(starts, len(who)))
            held.clear(), owner.clear()
            size = 0

        for k, data in enumerate(texts):
            rows = chunked(data)
            for lo in range(0, len(rows), BLOCK):
                held.append(rows[lo : lo + BLOCK])
                owner.append(np.full(len(held[-1]), k))
                size += len(held[-1])
                if size >= BLOCK:
                    flush()
        flush()
        logit = (total / count[:, None]) @ self.p["mean"].astype(float) + most @ self.p["max"].astype(float) + float(self.p["base"][0])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = np.concatenate([rng.permutation(len(docs)) for _ in range(-(-STEPS * BATCH // len(docs)))])
        for step in range(1, STEPS + 1):
            own = order[(step - 1) * BATCH : step * BATCH]
            grads = self.gradients([docs[i] for i in own], labels[own])
            rate = RATE * (1 - (step - 1) / STEPS)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        chunks = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        pooled, at = self.pooled(chunks, places=True)
        mean, most, prob = self.combine(pooled, starts)
        off = (prob - labels) / len(docs)
        owner = np.repeat(np.arange(len(docs)), sizes)
        down = (off / sizes)[owner, None] * self.p["mean"]
        # the maximum over chunks: its gradient goes to the chunks that reach it, in equal parts
        reach = pooled == most[owner]
        ties = np.add.reduceat(reach.astype(float), starts, axis=0)
        down = down + reach * (off[owner, None] * self.p["max"]) / ties[owner]
        down = np.where(pooled > 0, down, 0)
        rows = np.arange(len(chunks))
        g_filters, g_embed = np.zeros_like(self.p["filters"], np.float64), np.zeros((256, EMBED))
        for f in range(FILTERS):
            bytes_ = chunks[rows[:, None], at[:, f][:, None] + np.arange(WIDTH)]
            seen = self.p["embed"][bytes_].reshape(len(rows), -1)
            g_filters[:, f] = down[:, f] @ seen
            back = down[:, f][:, None] * self.p["filters"][:, f]
            np.add.at(g_embed, bytes_.ravel(), back.reshape(-1, EMBED))
        return {
            "embed": g_embed, "filters": g_filters, "bias": down.sum(0),
            "mean": off @ mean, "max": off @ most, "base": np.array([off.sum()]),
        }


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Chunks and labels of the training sample (its bounds are this module's parameters)."""
    common.prepare(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id")) != 0)
    chosen = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_ROWS)
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_CHUNKS * CHUNK
    rows = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = chunked((batch.column(2)[i].as_py() or "").encode())
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1).cast(pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["doc_id", "quality", "chunks"])

    # a repeated id could bring more rows than were chosen: the bound holds for rows, too
    got = rows.mapInArrow(cut, "doc_id long, quality int, chunks binary").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "chunks").limit(SAMPLE_ROWS).toArrow()
    chunks = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, CHUNK + WIDTH - 1) for x in got.column("chunks")]
    return chunks, got.column("quality").to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame) -> Network:
    chunks, known = sample(docs, labels)
    share = (known.sum() + 1) / (len(known) + 2)
    net = Network(float(share))
    if 0 < known.sum() < len(known):
        net.fit(chunks, known)
    else:
        net.p["mean"][:] = 0
        net.p["max"][:] = 0
    return net


def score(df: DataFrame, text: str, net: Network) -> Column:
    """The probability of label 1 for each whole text."""
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for lo in range(0, len(texts), 256):
                rows = [(t or "").encode() for t in texts.slice(lo, 256).to_pylist()]
                yield pa.array(shared.value.scores(rows), pa.float64())

    return run(df[f"`{text}`"])


def digests(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    scored = docs.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), score(docs, "text", train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
