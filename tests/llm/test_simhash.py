import random
import re

import numpy as np
import pytest
import xxhash

from rankfuse.llm import simhash as S


def plain(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[j : j + shingle]) for j in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(ids, prints, bits=4):
    f = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= bits)
    label = S.united(len(f), a, b)
    least = {}
    for i, x in zip(ids, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [least.get(x) for x in label]


@pytest.mark.parametrize("cell", [30_000, 1])
def test_rows(docs, rows, none, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL_ROWS", cell)
    prints = [plain(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute([r[0] for r in rows], prints)), key=str)
    got = sorted(map(tuple, S.digests(docs).collect()), key=str)
    assert got == want
    assert S.digests(none).collect() == []


def test_dedup_keeps_one_of_each(docs, rows, none):
    out = S.dedup(docs)
    assert out.schema == docs.schema
    prints = [plain(r[1]) for r in rows]
    f = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    assert out.count() == len(set(S.united(len(f), a, b)))
    want = {c for c in brute([r[0] for r in rows], prints) if c is not None}
    assert {r.doc_id for r in out.collect()} - {None} == want
    assert S.dedup(none).collect() == []


def near(rng, n, turns):
    base = rng.integers(0, 2**63, n // 6, dtype=np.uint64)
    keys = [base]
    for _ in range(5):
        x = base.copy()
        for _ in range(rng.integers(1, turns)):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        keys.append(x)
    keys.append(rng.integers(0, 4096, 100).astype(np.uint64))
    return np.unique(np.concatenate(keys))


@pytest.mark.parametrize("leaf", [1, 16, 256])
@pytest.mark.parametrize("depth", [0, 4, 13])
def test_trie_against_all_pairs(leaf, depth, monkeypatch):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "BLOCK", 1000)
    monkeypatch.setattr(S, "FRONTIER", 50)
    keys = near(np.random.default_rng(depth), 600, 6)
    close = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
    if depth:
        close &= (keys[:, None] >> np.uint64(64 - depth)) == (keys[None, :] >> np.uint64(64 - depth))
    a, b = np.nonzero(close)
    assert (S.trie_links(keys, depth, 4) == S.united(len(keys), a, b)).all()


def test_pairs_of_nodes_together_are_the_whole():
    keys, depth = near(np.random.default_rng(9), 900, 5), 3
    node = (keys >> np.uint64(64 - depth - S.SPLIT_BITS)) & np.uint64(63)
    a, b = [], []
    for x in range(64):
        for y in range(x, 64):
            at = np.flatnonzero((node == x) | (node == y))
            if (x ^ y).bit_count() <= 4 and len(at):
                a.append(at)
                b.append(at[S.trie_links(keys[at], depth, 4, (x, y))])
    assert (S.united(len(keys), np.concatenate(a), np.concatenate(b)) == S.trie_links(keys, depth, 4)).all()


def test_components_of_long_chains(spark):
    rnd = random.Random(2)
    order = rnd.sample(range(-500, 500), 300)
    edges = list(zip(order[:100], order[1:100])) + [(x, order[200]) for x in order[201:]] + [(1000, 1000)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(order[:100]) for x in order[:100]} | {x: min(order[200:]) for x in order[200:]}
    assert got == {k: v for k, v in want.items() if k != v}


def test_blocks_cover_all_bits():
    for bits in range(0, 9):
        parts = S.blocks(bits)
        assert sum(w for _, w in parts) == 64 and [a for a, _ in parts] == [sum(w for _, w in parts[:k]) for k in range(len(parts))]
