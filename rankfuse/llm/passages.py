"""Removal of recurring passages with sharded Aho-Corasick automata.

A *window* is ``WINDOW`` consecutive words of one text; it recurs if its words also start
anywhere else. Every word that a recurring window covers is removed.

1. *Candidates.* In each window the smallest hash of ``GRAM`` consecutive words is its anchor, so
   equal windows have equal anchors. Neighbouring windows of one anchor are a *segment* (some 15
   windows, more where words repeat): a row of hashes, a few per cent of the text's size.
   Anchors are counted by a narrow aggregation; segments whose anchor recurs are the candidates.
2. *Confirmation.* Of equal candidate segments one place gives its words. They are dealt by anchor,
   and the windows of an anchor are counted word by word; runs of windows that are there twice
   are the *passages*. An anchor with more than ``SALT_ROWS`` different segments (the edge of a
   passage that many documents share) is not gathered: its windows are counted by 128-bit hash,
   all over the cluster, and its segments are dealt to several tasks, its passages to each. Most
   of its windows need no counting: segments are aligned at the anchor and sorted by the words
   before it, and by those after it. Among its neighbours there a segment has the one with which it
   shares most words on that side; a window that reaches further on either side is there once.
3. *Automata.* Each task compiles its passages, some ``SHARD_ROWS`` segments at a time, into
   Aho-Corasick automata over word sequences (pyahocorasick), streams the segments' words through
   them, and locates every occurrence. A stretch that many documents repeat is streamed once, and
   what was found there goes to all its places by an equi-join on its hashes.
4. *Removal.* Each document's covered ranges meet its text.

So all texts are streamed, but each stretch only past the automaton of its anchor: the work grows
with the text and not with text times shards. Words are told by 64-bit chains of non-linear mixing,
equal segments by 64-bit XXH3 over those: neither has pairs that collide by construction, as
polynomial hashes have. The automata compare words themselves.

Nulls: a null text has no words; a null id is an id like others. Texts of fewer words than a
window are kept whole. Repeated rows are separate texts (so their windows recur). Empty tables
give empty results. Extra columns are kept by ``remove``. A task holds some ``SLICE_BYTES`` of
text at a time, or one text if that is longer.
"""

from __future__ import annotations

import itertools
import os
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 35
GRAM = 6
SLICE_BYTES = 2 << 20
#: Segments that one automaton sees, about; different ones of one anchor, at most.
SHARD_ROWS = 20_000
SALT_ROWS = 1_000
#: Documents whose keys (two longs each) may be broadcast to spare the others' texts a shuffle.
KEYS_SENT = 1 << 18

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chained(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One link of a chain of hashes: all bits of both go into all bits of the result, by no linear map,
    so that (unlike in sums of powers) no pairs of chains collide by construction."""
    return mixed(h ^ mixed(block + U(BASES[0]))) + U(BASES[1])


def word_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``start``: chains over their blocks of eight bytes, then their sizes.

    All words take their k-th link together; only long ones are left for later ones."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    blocks = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], U)
    out = np.full(len(start), BASES[1], U)
    left, at, done = np.arange(len(start)), start, 0
    while len(left):
        rest = size[left] - done
        out[left] = chained(out[left], blocks[at] & masks[np.minimum(rest, 8) - 1])
        more = rest > 8
        left, at, done = left[more], at[more] + 8, done + 8
    return mixed(out ^ size.astype(U))


class Words:
    """The words of some texts, one after another, with hashes of their runs.

    ``first[d] .. first[d + 1]`` are the words of text ``d``; words end at ASCII white space only.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        _, edges, data = texts.buffers()
        edge = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.empty(0, np.uint8)
        edge = edge - edge[0]
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        opens = np.append(True, space[:-1]) if len(raw) else np.empty(0, bool)
        opens[edge[:-1][edge[:-1] < len(raw)]] = True
        self.start = np.flatnonzero(opens & ~space)
        closes = np.append(space[1:], True) if len(raw) else np.empty(0, bool)
        inner = edge[1:][(edge[1:] > 0)] - 1
        closes[inner] = True
        self.end = np.flatnonzero(closes & ~space) + 1
        self.first = np.searchsorted(self.start, edge)
        self.raw, self.n = raw, len(self.start)
        self._sums: dict[int, np.ndarray] = {}
        self.word = self._hashes()

    def _hashes(self) -> np.ndarray:
        return word_hashes(self.raw, self.start, self.end - self.start) if self.n else np.empty(0, U)

    def contents(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XXH3 of the ``size`` words from each of ``at``, over the words' own hashes."""
        line = memoryview(self.word.tobytes())
        return np.array([xxhash.xxh3_64_intdigest(line[8 * a : 8 * b]) for a, b in zip(at.tolist(), (at + size).tolist())], U)

    def runs(self, at: np.ndarray, size: np.ndarray | int, which: int) -> np.ndarray:
        """Hashes of the ``size`` words from each of ``at``."""
        if which not in self._sums:
            inverse = pow(BASES[which], -1, 1 << 64)
            term = (self.word if which == 0 else mixed(self.word ^ U(BASES[1]))) * powers(BASES[which], self.n)
            self._sums[which] = np.append(np.zeros(1, U), np.cumsum(term, dtype=U))
            self._sums[which + 2] = powers(inverse, self.n)
        sums = self._sums[which]
        return mixed((sums[at + size] - sums[at]) * self._sums[which + 2][at])

    def segments(self) -> dict[str, np.ndarray]:
        """``doc, start, n, anchor, content, chances`` of each segment; ``start`` counts from the text's
        first word, ``chances`` is 2 if one of its windows may be there twice, else 1."""
        count = np.diff(self.first)
        total = np.maximum(count - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(count)), total)
        at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        at = at + self.first[:-1][doc]
        if not len(at):
            return {k: np.empty(0, np.int64) for k in ("doc", "start", "n", "anchor", "content", "chances")}
        grams = self.runs(np.arange(self.n - GRAM + 1), GRAM, 0)
        best = np.arange(len(grams))
        width, span = 1, WINDOW - GRAM + 1

        def wider(best: np.ndarray, step: int) -> np.ndarray:
            left, right = best[: len(best) - step], best[step:]
            return np.where(grams[right] < grams[left], right, left)

        while width * 2 <= span:
            best, width = wider(best, width), width * 2
        if width < span:
            best = wider(best, span - width)
        anchor = best[at]
        value = grams[anchor]
        lead = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
        n = np.diff(np.append(lead, len(at)))
        begin, own = at[lead], doc[lead]
        return {
            "doc": own, "start": begin - self.first[own], "n": n,
            "anchor": value[lead].view(np.int64),
            "content": self.contents(begin, n + WINDOW - 1).view(np.int64),
            "chances": 1 + (anchor[lead] != anchor[lead + n - 1]),
        }

    def bodies(self, lo: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The ``size`` words from each of ``lo``, joined by one space."""
        own = self.end - self.start
        to = np.cumsum(own + 1) - own - 1
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        line = np.full(int(own.sum()) + self.n, 32, np.uint8)
        line[np.repeat(to, own) + place] = self.raw[np.repeat(self.start, own) + place]
        line, last = line.tobytes(), lo + size - 1
        return [line[a:b] for a, b in zip(to[lo].tolist(), (to[last] + own[last]).tolist())]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES`` of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    lo, seen = 0, 0
    for i, s in enumerate(sizes.to_pylist()):
        if i > lo and seen + s > SLICE_BYTES:
            yield batch.slice(lo, i - lo)
            lo, seen = i, 0
        seen += s
    if lo < batch.num_rows:
        yield batch.slice(lo)


def texts_of(batch: pa.RecordBatch, column: int) -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            got = Words(texts_of(batch, 2)).segments()
            doc = got.pop("doc")
            if len(doc):
                keys = [np.asarray(batch.column(k))[doc] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[0]), pa.array(keys[1]), pa.array(got["start"], pa.int64()), pa.array(got["n"], pa.int32()),
                    pa.array(got["anchor"]), pa.array(got["content"]), pa.array(got["chances"], pa.int32()),
                ], names=["file", "at", "start", "n", "anchor", "content", "chances"])


def fetch_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted segments of each text; for hot anchors the hashes of their windows."""
    for whole in batches:
        for batch in slices(whole, 0):
            words = Words(texts_of(batch, 0))
            lists = batch.column(1)
            got = dict(zip(("start", "n", "anchor", "content", "weight", "hot"), lists.flatten().flatten()))
            doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            n, hot = np.asarray(got["n"]), got["hot"].to_numpy(zero_copy_only=False)
            lo = words.first[doc] + np.asarray(got["start"])
            some = np.where(hot, n, 0)
            ends = np.cumsum(some)
            at = np.arange(some.sum()) - np.repeat(ends - some, some) + np.repeat(lo, some)
            edges = pa.array(np.append(0, ends), pa.int32())
            hashes = [pa.ListArray.from_arrays(edges, pa.array(words.runs(at, WINDOW, k).view(np.int64))) for k in (0, 1)]
            anchor = np.asarray(got["anchor"]).view(U)
            spots = [np.flatnonzero(words.runs(np.arange(a, a + k + WINDOW - GRAM), GRAM, 0) == v).tolist() if h else []
                     for a, k, v, h in zip(lo.tolist(), n.tolist(), anchor, hot.tolist())]
            yield pa.RecordBatch.from_arrays([
                got["anchor"], got["content"], got["weight"], got["hot"],
                pa.array(words.bodies(lo, n + WINDOW - 1), pa.binary()), *hashes, pa.array(spots, pa.list_(pa.int32())),
            ], names=["anchor", "content", "weight", "hot", "body", "one", "two", "spots"])


#: Words of a window beside its anchor.
BESIDE = WINDOW - GRAM


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment and place of its anchor in it the words before (side 0, backwards) and after."""
    for batch in batches:
        rows = []
        for anchor, content, body, spots in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = body.split(b" ")
            for p in spots:
                before, after = words[max(0, p - BESIDE) : p][::-1], words[p + GRAM : p + GRAM + BESIDE]
                rows += [(anchor, content, side, b"".join(w + b" " for w in key)) for side, key in enumerate((before, after))]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                         names=["anchor", "content", "side", "key"])


def shared_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, side and key: how many words each shares with a neighbour. The first and
    last of a task have neighbours elsewhere: they may share all."""
    last: tuple | None = None
    shared = BESIDE
    for batch in batches:
        out = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            common_words = 0
            if last is not None:
                if row[0] == last[0] and row[2] == last[2]:
                    common_words = os.path.commonprefix([row[3], last[3]]).count(b" ")
                out.append((*last[:3], max(shared, common_words)))
                shared = common_words
            last = row
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                         names=["anchor", "content", "side", "shared"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*last[:3], BESIDE), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                         names=["anchor", "content", "side", "shared"])


def possible_windows(hot: DataFrame) -> DataFrame:
    """``anchor, content, weight, i, one, two``: the windows of hot segments that can be there twice."""
    sides = hot.select("anchor", "content", "body", "spots").mapInArrow(aligned, "anchor long, content long, side int, key binary")
    sides = sides.repartitionByRange("anchor", "side", "key").sortWithinPartitions("anchor", "side", "key")
    beside = sides.mapInArrow(shared_beside, "anchor long, content long, side int, shared int").groupBy("anchor", "content").agg(
        F.max(F.when(F.col("side") == 0, F.col("shared"))).alias("before"), F.max(F.when(F.col("side") == 1, F.col("shared"))).alias("after"))
    rows = hot.join(beside, ["anchor", "content"])
    # a segment that is there twice, or in which the anchor is, keeps all its windows
    free = (F.col("weight") > 1) | (F.size("spots") != 1)
    last, spot = F.size("one") - 1, F.try_element_at("spots", F.lit(1))
    lo = F.when(free, F.lit(0)).otherwise(F.greatest(F.lit(0), spot - F.col("before")))
    up = F.when(free, last).otherwise(F.least(last, spot + F.col("after") - F.lit(BESIDE)))
    cut = rows.select("anchor", "content", "weight", lo.alias("lo"), F.greatest(F.lit(0), up - lo + 1).alias("n"), "one", "two")
    some = cut.where("n > 0").select("anchor", "content", "weight", "lo", F.arrays_zip(
        F.slice("one", F.col("lo") + 1, F.col("n")).alias("one"), F.slice("two", F.col("lo") + 1, F.col("n")).alias("two")).alias("w"))
    return some.select("anchor", "content", "weight", "lo", F.posexplode("w").alias("i", "w")).select(
        "anchor", "content", "weight", (F.col("lo") + F.col("i")).alias("i"), "w.one", "w.two")


def runs_of(places: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive places (ascending)."""
    lo = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            yield places[lo], places[i - 1]
            lo = i


def cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of hot segments: the words of their runs of confirmed windows."""
    for batch in batches:
        anchors, bodies = [], []
        for anchor, body, places in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = body.split(b" ")
            for lo, up in runs_of(sorted(places)):
                anchors.append(anchor), bodies.append(b" ".join(words[lo : up + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(bodies, pa.binary())], names=["anchor", "body"])


class Shard:
    """An Aho-Corasick automaton over sequences of words (numbers stand for them), and the segments
    that wait to be streamed through it."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.waiting: list[tuple[int, int, tuple[int, ...]]] = []

    def group(self, rows: list[tuple]) -> None:
        """The rows (anchor, salt, kind, content, weight, hot, body) of one anchor and salt."""
        keys = []
        for *_, body in rows:
            keys.append(tuple([self.number.setdefault(w, len(self.number)) for w in body.split(b" ")]))
        segments = [(r, k) for r, k in zip(rows, keys) if r[2]]
        self.waiting += [(r[0], r[3], k) for r, k in segments]
        if rows[0][5]:  # hot: passages come confirmed
            for r, k in zip(rows, keys):
                if not r[2]:
                    self.trie.add_word(k, len(k))
            return
        seen: Counter = Counter()
        for r, k in segments:
            for j in range(len(k) - WINDOW + 1):
                seen[k[j : j + WINDOW]] += r[4]
        for _, k in segments:
            for lo, up in runs_of([j for j in range(len(k) - WINDOW + 1) if seen[k[j : j + WINDOW]] > 1]):
                key = k[lo : up + WINDOW]
                self.trie.add_word(key, len(key))

    def located(self) -> pa.RecordBatch:
        """Merged ranges of the words that passages cover, for each segment that has some."""
        anchors, contents, edges, los, ups = [], [], [0], [], []
        if len(self.trie):
            self.trie.make_automaton()
            for anchor, content, key in self.waiting:
                found: list[tuple[int, int]] = []
                for end, size in self.trie.iter(key):
                    lo = end - size + 1
                    while found and found[-1][1] >= lo:
                        lo = min(lo, found.pop()[0])
                    found.append((lo, end + 1))
                if found:
                    anchors.append(anchor), contents.append(content), edges.append(edges[-1] + len(found))
                    los += [a for a, _ in found]
                    ups += [b for _, b in found]
        ranges = pa.StructArray.from_arrays([pa.array(los, pa.int64()), pa.array(ups, pa.int64())], names=["lo", "up"])
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ranges)
        return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(contents, pa.int64()), lists], names=["anchor", "content", "ranges"])


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, in order of anchor and salt: compiles automata and streams segments through them."""
    shard, group = Shard(), []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if group and group[0][:2] != row[:2]:
                shard.group(group)
                group = []
                if len(shard.waiting) >= SHARD_ROWS:
                    yield shard.located()
                    shard = Shard()
            group.append(row)
    if group:
        shard.group(group)
    yield shard.located()


def covered(rows: DataFrame) -> DataFrame:
    """``file, at, ranges``: for each of ``rows`` (``file, at, text``) with recurring passages, the
    ranges of words that they cover."""
    common.prepare(rows.sparkSession)
    segments = common.stage(rows.select("file", "at", "text").mapInArrow(
        find_segments, "file long, at long, start long, n int, anchor long, content long, chances int"), "segments")
    again = segments.groupBy("anchor").agg(F.sum("chances").alias("times")).where(F.col("times") > 1).select("anchor")
    candidates = common.stage(segments.join(again, "anchor", "left_semi"), "candidates")

    # one row for each different segment, with one of its places
    place = F.struct("file", "at", "start", "n")
    distinct = candidates.groupBy("anchor", "content").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("weight"), F.min(place).alias("place"))
    distinct = common.stage(distinct, "distinct-segments")
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > SALT_ROWS)
    kinds = common.stage(kinds, "hot-anchors")
    wanted = distinct.join(kinds, "anchor", "left").select("place.*", "anchor", "content", "weight", F.col("kinds").isNotNull().alias("hot"))
    asked = wanted.groupBy("file", "at").agg(F.collect_list(F.struct("start", "n", "anchor", "content", "weight", "hot")).alias("wanted"))
    keys = common.stage(distinct.select("place.file", "place.at").distinct(), "wanted-texts")
    texts = rows
    if keys.count() <= KEYS_SENT:
        texts = rows.join(F.broadcast(keys), ["file", "at"], "left_semi")
    bodies = texts.join(asked, ["file", "at"]).select("text", "wanted").mapInArrow(
        fetch_bodies, "anchor long, content long, weight int, hot boolean, body binary, one array<long>, two array<long>, spots array<int>")
    bodies = common.stage(bodies, "bodies")

    # hot anchors: their windows are counted by hash, their passages go to all their salts
    hot = bodies.where("hot")
    windows = common.stage(possible_windows(hot), "hot-windows")
    twice = windows.groupBy("one", "two").agg(F.sum("weight").alias("times")).where(F.col("times") > 1).select("one", "two")
    places = windows.join(twice, ["one", "two"], "left_semi").groupBy("anchor", "content").agg(F.collect_list("i").alias("places"))
    described = hot.select("anchor", "content", "body").join(places, ["anchor", "content"])
    passages = described.select("anchor", "body", "places").mapInArrow(cut_passages, "anchor long, body binary").distinct()
    salts = kinds.select("anchor", F.ceil(F.col("kinds") / SALT_ROWS).alias("salts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    passages = passages.join(salts, "anchor").select(
        "anchor", every, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("content"), F.lit(0).alias("weight"), F.lit(True).alias("hot"), "body")
    salt = F.pmod("content", F.coalesce("salts", F.lit(1).cast("long"))).alias("salt")
    dealt = passages.unionByName(bodies.join(salts, "anchor", "left").select("anchor", salt, F.lit(1).alias("kind"), "content", "weight", "hot", "body"))
    dealt = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "kind")
    found = dealt.mapInArrow(locate, "anchor long, content long, ranges array<struct<lo: long, up: long>>")

    placed = candidates.join(common.stage(found, "found"), ["anchor", "content"])
    shifted = F.transform("ranges", lambda r: F.struct((r.lo + F.col("start")).alias("lo"), (r.up + F.col("start")).alias("up")))
    return placed.select("file", "at", shifted.alias("ranges")).groupBy("file", "at").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def stripped(text: Column, ranges: Column) -> Column:
    """A struct ``n_words, n_removed, kept``: the words that no range covers, joined by one space."""

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: binary>")
    def strip(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            for lo in range(0, len(texts), 256):
                sizes, gone, kept = [], [], []
                for t, rs in zip(texts.slice(lo, 256).to_pylist(), lists.slice(lo, 256).to_pylist()):
                    words = (t or "").encode().split()
                    sizes.append(len(words))
                    if rs:
                        stay = bytearray(b"\x01") * len(words)
                        for r in rs:
                            stay[r["lo"] : r["up"]] = bytes(r["up"] - r["lo"])
                        words = list(itertools.compress(words, stay))
                    gone.append(sizes[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.StructArray.from_arrays(
                    [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                    names=["n_words", "n_removed", "kept"])

    return strip(text, ranges)


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words joined by one space (null stays null), and
    the columns ``n_words`` and ``n_removed`` (existing ones of these names are replaced)."""
    row, ranges, out = common.fresh(docs, "row", "ranges", "stripped")
    rows = common.located(docs, row)
    gone = covered(rows.select(f"{row}.file", f"{row}.at", F.col(f"`{text}`").alias("text")))
    gone = gone.select(F.struct("file", "at").alias(row), F.col("ranges").alias(ranges))
    both = rows.join(gone, row, "left").withColumn(out, stripped(F.col(f"`{text}`"), F.col(ranges)))
    new = F.when(F.col(f"`{text}`").isNotNull(), F.col(out)["kept"].cast("string")).alias(text)
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    return both.select(*[new if c == text else F.col(f"`{c}`") for c in keep], f"{out}.n_words", f"{out}.n_removed")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    out = remove(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i + 1 : i + 35], ' ') AS s
  FROM (SELECT r, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS k FROM windows JOIN again USING (s), range(35) t(j)),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
