import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankfuse.llm import passages as P


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[j : j + 35]) for w in words for j in range(len(w) - 34))
    out = []
    for w in words:
        gone = bytearray(len(w))
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = b"\1" * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "the", "x" * rnd.randrange(1, 9), str(rnd.randrange(40))])
    shared = [[word() for _ in range(rnd.choice([34, 35, 36, 50, 120]))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randrange(5)):
            w += [word() for _ in range(rnd.randrange(60))]
            w += rnd.choice(shared)[rnd.randrange(5) :]
        out.append(rnd.choice([" ", "\n", " \t "]).join(w))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_planted_passages(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(P, "SHARD_ROWS", 10)
        monkeypatch.setattr(P, "SALT_ROWS", 2)
        monkeypatch.setattr(P, "SLICE_BYTES", 500)
        monkeypatch.setattr(P, "KEYS_SENT", -1)  # texts are shuffled to their keys
    texts = [t for seed in range(3) for t in planted(seed)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in P.digests(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_edge_rows(docs, rows, none):
    got = sorted(map(tuple, P.digests(docs).collect()), key=str)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))), key=str)
    assert P.digests(none).collect() == []


def test_one_text_repeats_itself_and_34_words_do_not_count(spark):
    run = [f"w{k}" for k in range(35)]
    texts = [" ".join(run + ["x"] + run), " ".join(run[:34]), " ".join(["y"] + run[:34]), "same " * 36, "same " * 35, " ".join(f"{k % 20}" for k in range(50)), " ".join(f"z{k % 20}" for k in range(56))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in P.digests(df).collect()}
    assert got == {0: 70, 1: 0, 2: 0, 3: 36, 4: 35, 5: 0, 6: 56}


def morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(1 << n)]


def test_words_that_collide_under_polynomial_hashes(spark):
    lead = " ".join(f"w{k}" for k in range(34))
    one, two = ("".join(morse(10, *ab)) for ab in ("ab", "ba"))
    texts = [f"{lead} {one}", f"{lead} {two}", f"{lead} {one} x", " ".join(morse(11, "left", "right")) + " end", " ".join(morse(11, "right", "left")) + " stop"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in P.digests(df).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert (got[0][1], got[1][1]) == (35, 0)
    hashes = P.Words(pa.array([f"{one} {two} {one}"])).word
    assert hashes[0] == hashes[2] != hashes[1]


def test_word_hashes_tell_bytes_and_sizes_apart():
    words = ["a", "b", "ab", "a\0", "a\0\0", "\0", "\0\0", "12345678", "123456789", "12345678\0", "x" * 17, "x" * 16, "é", "ab" * 500, "ba" * 500]
    got = P.Words(pa.array([" ".join(words), " ".join(reversed(words))])).word
    assert len(set(got.tolist())) == len(words)
    assert got[: len(words)].tolist() == got[len(words) :][::-1].tolist()


def test_remove_keeps_columns(docs, none):
    out = P.remove(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    by = {r.doc_id: r for r in out.collect()}
    assert by[4].text is None and by[1].text == "" and by[8].text == "one"
    assert P.remove(none).collect() == []


def test_words_and_hashes():
    texts = ["", " a  bb\tccc ", "x", "é\xa0y\x1cz  w", "\n", "a bb ccc"]
    words = P.Words(pa.array(["skip me", *texts])[1:])
    for d, t in enumerate(texts):
        own = [words.raw[a:b].tobytes() for a, b in zip(words.start, words.end)][words.first[d] : words.first[d + 1]]
        assert own == t.encode().split()
    a, b = words.first[1], words.first[5]
    for which in (0, 1):
        assert words.runs(np.array([a]), 3, which)[0] == words.runs(np.array([b]), 3, which)[0]
        assert words.runs(np.array([a]), 2, which)[0] != words.runs(np.array([b + 1]), 2, which)[0]


def test_segments_cover_each_window_once():
    texts = planted(4, 20)
    words = P.Words(pa.array(texts))
    got = words.segments()
    seen = sorted((d, s + i) for d, s, n in zip(got["doc"], got["start"], got["n"]) for i in range(n))
    assert seen == [(d, j) for d, t in enumerate(texts) for j in range(len(t.split()) - 34)]
    assert (got["n"][got["chances"] == 1] <= P.WINDOW - P.GRAM + 1).all()
