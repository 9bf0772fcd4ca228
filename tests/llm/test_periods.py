import hashlib
import random
import zlib

import numpy as np
import pytest

from rankfuse.llm import periods as P


def brute_runs(words):
    """Every maximal stretch of every period by comparing words; smallest periods by trying all."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                block = words[i : i + length]
                if not any(all(block[k] == block[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic_texts(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randrange(1, 4)):
            w += [rnd.choice("abcdefgh") for _ in range(rnd.randrange(40))]
            q = rnd.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40])
            root = [rnd.choice("abxyz") * rnd.randrange(1, 3) for _ in range(q)]
            w += (root * 12)[: int(q * rnd.uniform(2.5, 7)) + rnd.randrange(25)]
        out.append(" ".join(w))
    return out


def solved(words):
    """The operator's tiles and fragments, stitched in plain Python."""
    ids = P.numbered(words)
    parts = set()
    for low, m, lo, up in P.live_tiles(ids):
        for q, a, b in P.fragments(ids[lo:up].tolist(), low, m - lo, lo == 0, up == len(ids)):
            parts.add((q, lo + a, lo + b))
    out = []
    for q, a, b in sorted(parts):
        if out and out[-1][2] == q and a <= out[-1][1] - q:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, q])
    return sorted([(a, b - a, q) for a, b, q in out if b - a >= max(24, 3 * q)], key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_tiles_find_all_runs(seed):
    for text in periodic_texts(seed):
        words = text.encode().split()
        assert solved(words) == brute_runs(words)


@pytest.mark.parametrize("text", ["a " * 500, "a b " * 300, ("a " * 9 + "b ") * 60, "a " * 23, "a " * 24, "a b c d e f g h i " * 3,
                                  " ".join("ab"[bin(i).count("1") % 2] for i in range(512)), ("x y " * 40 + "z ") * 4])
def test_special_texts(text):
    words = text.encode().split()
    assert solved(words) == brute_runs(words)


def test_z_function():
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.randrange(2) for _ in range(rnd.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert P.z_function(s) == want


def test_digests_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(periodic_texts(9, 60))] + [(1000 + k, " ".join(f"w{j}" for j in range(k))) for k in range(60, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, P.digests(df).collect())) == sorted(brute(*r) for r in rows)


def test_edge_rows(docs, rows, none):
    got = sorted(map(tuple, P.digests(docs).collect()), key=str)
    assert got == sorted((brute(r[0], r[1]) for r in rows), key=str)
    assert P.digests(none).collect() == []


def test_a_very_long_text_is_many_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "FLUSH", 5000)
    words = [f"w{k}" for k in range(700)] * 5 + ["x"] * 3000
    got = P.digests(spark.createDataFrame([(3, " ".join(words))], "doc_id long, text string")).first()
    assert (got.n_runs, got.start, got.length, got.period) == (2, 3500, 3000, 1)
    assert got.runs_sha256 == hashlib.sha256(b"0,3500,700\n3500,3000,1\n").hexdigest()
    assert len(list(P.live_tiles(P.numbered(words)))) > 100


def test_collapse_keeps_columns(docs, none):
    out = P.collapse(docs)
    assert out.columns == [*docs.columns, "n_words", "runs"]
    by = {r.doc_id: r for r in out.collect()}
    assert by[4].text is None and by[5].text == "" and by[8].text == "one"
    assert by[11].text == "Und" and [tuple(x) for x in by[11].runs] == [(0, 200, 1)]
    assert P.collapse(none).collect() == []


def test_hashes_of_live_tiles_are_never_missing():
    rnd = np.random.default_rng(3)
    root = rnd.integers(0, 1000, 5000)
    words = np.concatenate([rnd.integers(0, 1000, 777), np.tile(root, 4)[:16000], rnd.integers(0, 1000, 333)]).astype(np.int32)
    assert any(low == 4096 for low, *_ in P.live_tiles(words))
