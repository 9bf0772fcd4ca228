"""SimHash near-dedup: 64-bit fingerprints, linked by a binary trie self-join.

1. *Fingerprints.* ASCII lower case, white-space words, shingles of ``shingle`` words (repeats
   count; a shorter text is one shingle), XXH64 with seed 42; a bit is 1 if over half of the
   shingles' hashes have it. A text without words has fingerprint 0, linked like any other.
2. *Dealing out.* Equal fingerprints are one node from here on. Fingerprints within ``bits``
   differing bits agree on all of one of ``bits + 1`` blocks, so for each block they are rotated
   to put it first, and that many tries are joined with themselves, each from the depth where
   the block ends. The leading bits name a *cell*, one task's share of a trie. A cell of more
   than ``CELL_ROWS`` is dealt out again as pairs of nodes ``SPLIT_BITS`` deeper, each
   fingerprint to the pairs whose accumulated difference is within the budget.
3. *Trie self-join* of a cell: a frontier of node pairs (ranges of the sorted fingerprints) goes
   down bit by bit; differing children cost one, pairs over the budget go, and pairs of few
   fingerprints are compared directly. Fingerprints one bit apart are united first, and a pair
   of nodes that lie in one component altogether goes too: of a dense ball no more than a
   spanning forest is traversed or returned.
4. *Components* of the cells' forests: alternating large-star and small-star steps on staged
   tables, as joins and minima; nothing is collected.

Nulls: a null text is the empty text; null ids are never the smallest (a component of null ids
only has a null ``component_id``). Repeated rows share a fingerprint. Empty tables give empty
results. Extra columns are not looked at (``groups``) or kept (``dedup``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Fingerprints in a cell, about, and the number from which a cell is dealt out again.
CELL_ROWS = 30_000
SPLIT_BITS = 6
#: Node pairs of at most this product of sizes are compared directly; rows of such products, and node pairs, at a time.
LEAF = 256
BLOCK = 2_000_000
FRONTIER = 300_000


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int) -> Column:
    """The fingerprint of each text as a long (the same 64 bits)."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.array(got.view(np.int64), pa.int64())

    return run(text)


def blocks(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``bits + 1`` blocks that cover the 64."""
    edge = [64 * k // (bits + 1) for k in range(bits + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for edges a-b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def roots(keys: np.ndarray, depth: int, pair: tuple[int, int] | None) -> tuple:
    """The first frontier: each node at ``depth`` with itself; with ``pair``, the nodes
    ``SPLIT_BITS`` deeper that have these bits there, one with the other (or with itself)."""
    deep = depth + (SPLIT_BITS if pair else 0)
    prefix = keys >> np.uint64(64 - deep) if deep else np.zeros(len(keys), np.uint64)
    lo = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
    hi = np.append(lo[1:], len(keys))
    if pair is None or pair[0] == pair[1]:
        return deep, lo, hi, lo, hi, np.zeros(len(lo), np.int64)
    above = prefix[lo] >> np.uint64(SPLIT_BITS)
    a = np.flatnonzero(above[1:] == above[:-1])
    diff = np.full(len(a), (pair[0] ^ pair[1]).bit_count(), np.int64)
    return deep, lo[a], hi[a], lo[a + 1], hi[a + 1], diff


def trie_links(keys: np.ndarray, depth: int, budget: int, pair: tuple[int, int] | None = None) -> np.ndarray:
    """Component labels of sorted distinct 64-bit ``keys`` under links of at most ``budget``
    differing bits between keys that agree on the first ``depth`` bits.

    Labels are indexes into ``keys``. With ``pair`` all keys have one of the two in the next
    ``SPLIT_BITS``, and only links across are sought (within, if the two are one).
    """
    n = len(keys)
    if n < 2:
        return np.arange(n)
    near = []
    for bit in range(64 - depth):
        want = keys ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(keys, want), n - 1)
        hit = (keys[at] == want) & (at > np.arange(n))
        near.append((np.flatnonzero(hit), at[hit]))
    label = united(n, np.concatenate([a for a, _ in near]), np.concatenate([b for _, b in near]))
    change = np.cumsum(np.append(0, label[1:] != label[:-1]))
    stack = [roots(keys, depth, pair)]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    while stack:
        bit, la, ha, lb, hb, diff = stack.pop()
        same = la == lb
        # a pair of nodes in one component, or one node of a single key, has nothing left to link
        open_ = ~((change[ha - 1] == change[la]) & (change[hb - 1] == change[lb]) & (label[la] == label[lb]))
        la, ha, lb, hb, diff, same = la[open_], ha[open_], lb[open_], hb[open_], diff[open_], same[open_]
        if not len(la):
            continue
        small = (ha - la) * (hb - lb) <= LEAF
        if bit == 64:
            small[:] = True
        if small.any():
            links += list(compared(keys, label, la[small], ha[small], lb[small], hb[small], budget))
            la, ha, lb, hb, diff, same = (x[~small] for x in (la, ha, lb, hb, diff, same))
        if not len(la):
            continue
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack += [(bit, la[:half], ha[:half], lb[:half], hb[:half], diff[:half]), (bit, la[half:], ha[half:], lb[half:], hb[half:], diff[half:])]
            continue
        ma, mb = split_at(keys, la, ha, bit), split_at(keys, lb, hb, bit)
        # children: zero-zero, one-one, zero-one, one-zero (the last is the third's mirror in a pair of one node)
        pairs = [(la, ma, lb, mb, diff), (ma, ha, mb, hb, diff), (la, ma, mb, hb, diff + 1)]
        two = ~same
        pairs.append((ma[two], ha[two], lb[two], mb[two], diff[two] + 1))
        a, b, c, d, e = (np.concatenate(x) for x in zip(*pairs))
        live = (a < b) & (c < d) & (e <= budget)
        stack.append((bit + 1, a[live], b[live], c[live], d[live], e[live]))
    if links:
        label = united(n, np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links]))[label]
    return label


def split_at(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys of each node [lo, hi) begin to have ``bit`` (counted from the top) set."""
    mask = np.uint64(1 << (63 - bit))
    edge = ((keys[lo] >> np.uint64(63 - bit)) | np.uint64(1)) << np.uint64(63 - bit)
    edge = np.where(keys[lo] & mask, keys[lo], edge)
    return np.minimum(np.searchsorted(keys, edge), hi)


def compared(keys, label, la, ha, lb, hb, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct label pairs of the keys of small node pairs that are within the budget."""
    size = (ha - la) * (hb - lb)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        up = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
        part = slice(lo, up)
        at = np.arange(size[part].sum()) - np.repeat(ends[part] - size[part] - (ends[lo - 1] if lo else 0), size[part])
        width = np.repeat((hb - lb)[part], size[part])
        a = np.repeat(la[part], size[part]) + at // width
        b = np.repeat(lb[part], size[part]) + at % width
        hit = np.bitwise_count(keys[a] ^ keys[b]) <= budget
        x, y = label[a[hit]], label[b[hit]]
        new = x != y
        if new.any():
            both = np.unique(np.stack([np.minimum(x[new], y[new]), np.maximum(x[new], y[new])]), axis=1)
            yield both[0], both[1]
        lo = up


def cell_links(first: list[tuple[int, int]], budget: int):
    """For a cell (its keys are rotated fingerprints): each key with its root, if that is another."""

    def run(cell: pa.Table) -> pa.Table:
        band = cell.column("band")[0].as_py()
        start, width = first[band]
        keys = np.unique(cell.column("key").to_numpy().view(np.uint64))
        low, high = cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
        label = trie_links(keys, width, budget, None if low is None else (low, high))
        moved = label != np.arange(len(keys))
        back = np.uint64(start)
        turn = (lambda k: (k >> back) | (k << (np.uint64(64) - back))) if start else (lambda k: k)
        return pa.table({"a": turn(keys[moved]).view(np.int64), "b": turn(keys[label[moved]]).view(np.int64)})

    return run


def links(prints: DataFrame, bits: int) -> DataFrame:
    """Edges ``a, b`` over distinct fingerprints (column ``fp``, staged): forests of the cells."""
    first = blocks(bits)
    lead = min(w for _, w in first)
    top = min(lead, max(0, math.ceil(math.log2(max(1, prints.count() / CELL_ROWS)))))
    turned = [F.col("fp") if not s else F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) for s, _ in first]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), t.alias("key")) for k, t in enumerate(turned)])
    rows = prints.select(F.explode(bands).alias("x")).select("x.band", "x.key")
    rows = rows.withColumn("cell", F.shiftrightunsigned("key", 64 - top) if top else F.lit(0).cast("long"))
    large = rows.groupBy("band", "cell").count().where(F.col("count") > 2 * CELL_ROWS).select("band", "cell", F.lit(True).alias("large"))
    # few rows (one for every 2 * CELL_ROWS at most), from a table of known size
    rows = rows.join(common.stage(large, "large-cells"), ["band", "cell"], "left")
    # the node of a key: the bits after its block; its partners differ in no more than the budget
    width = F.element_at(F.array(*[F.lit(w) for _, w in first]), F.col("band") + 1)
    node = F.expr(f"shiftrightunsigned(shiftleft(key, width), {64 - SPLIT_BITS})")
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= bits]
    partners = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("node").bitwiseXOR(m))
    pairs = F.when(F.col("large"), partners).otherwise(F.array(F.lit(None).cast("long")))
    rows = rows.withColumn("width", width).withColumn("node", node).select("band", "key", "cell", "node", F.explode(pairs).alias("other"))
    low = F.when(F.col("other").isNotNull(), F.least("node", "other"))
    high = F.when(F.col("other").isNotNull(), F.greatest("node", "other"))
    rows = rows.select("band", "cell", low.alias("low"), high.alias("high"), "key")
    return rows.groupBy("band", "cell", "low", "high").applyInArrow(cell_links(first, bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that isn't its component's smallest; ``edges``: ``a, b``.

    Large-star: a node's larger neighbours go to its smallest neighbour. Small-star: its smaller
    neighbours do. The minima are staged, so that both sides of each join are plain shuffles and
    Spark can split the rows of a hub. The graph is a forest of stars when a round changes nothing, after a number
    of rounds that grows with the logarithm of the nodes.
    """
    state = common.stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = common.stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = common.stage(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, state = state, common.stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        for done in (old, least, large, low):
            common.unstage(done)


def groups(rows: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """``row, id, fp, first`` of each of ``rows`` (``row, id, text``).

    ``first`` is the (none, id, row) of the component's row with the smallest id, nulls last.
    """
    common.prepare(rows.sparkSession)
    prints = common.stage(rows.select("row", "id", fingerprints(F.col("text"), shingle).alias("fp")), "prints")
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    nodes = common.stage(prints.groupBy("fp").agg(F.min(own).alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = common.stage(placed.groupBy("root").agg(F.min("first").alias("first")), "components")
    found = placed.drop("first").join(least, "root").select("fp", "first")
    return prints.join(found, "fp")


def digests(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text")
    return groups(rows, shingle, bits).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the smallest id's."""
    row = common.fresh(docs, "row")[0]
    numbered = common.located(docs, row)
    found = groups(numbered.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), shingle, bits)
    gone = common.stage(found.where("first.row <> row").select(F.col("row").alias(row)), "simhash-gone")
    return numbered.join(gone, row, "left_anti").drop(row)
