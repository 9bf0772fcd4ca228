import random
import zlib

import numpy as np
import pytest

from rankfuse.llm import quality as Q


def texts(n, seed):
    rnd = random.Random(seed)
    words = "stone river light quick brown fox jumps over lazy dog and some more".split()
    for k in range(n):
        good = rnd.random() < 0.7
        body = " ".join(rnd.choice(words) if good else rnd.choice(words).upper() + "!!" for _ in range(rnd.randrange(5, 120)))
        yield k, body, int(good)


@pytest.fixture(scope="module")
def tables(spark):
    rows = list(texts(600, 1))
    docs = spark.createDataFrame([(k, t, "q", 0.5) for k, t, _ in rows], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {k: y for k, _, y in rows}


def test_held_out_accuracy(tables):
    docs, labels, known = tables
    got = Q.digests(docs, labels, 0.3).collect()
    assert len(got) == 600
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in known if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learned_from(tables, spark):
    docs, labels, _ = tables
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted(map(tuple, Q.digests(docs, x, 0.3).collect())) for x in (labels, turned))
    assert a == b


def test_whole_texts_count():
    net = Q.Network(0.5)
    tail = "stone river " * 2000
    a, b = net.scores([(tail + "fox").encode(), (tail + "XQ!!" * 80).encode()])
    assert a != b


def test_batches_and_blocks_change_nothing(monkeypatch):
    net = Q.Network(0.4)
    data = [t.encode() for _, t, _ in texts(40, 3)] + [b"", b"x" * 10_000]
    whole = net.scores(data)
    assert np.allclose(whole, [net.scores([d])[0] for d in data], atol=1e-6)
    monkeypatch.setattr(Q, "BLOCK", 3)
    assert np.allclose(whole, net.scores(data), atol=1e-6)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = Q.Network(0.5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs = [Q.chunked(bytes(rng.integers(97, 110, n, dtype=np.uint8))) for n in (300, 700, 40)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        chunks = np.concatenate(docs)
        starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
        pooled = net_pooled(net, chunks)
        _, _, p = net.combine(pooled, starts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    def net_pooled(net, chunks):
        seen = net.p["embed"][chunks].reshape(len(chunks), -1)
        w = np.lib.stride_tricks.sliding_window_view(seen, Q.WIDTH * Q.EMBED, axis=1)[:, :: Q.EMBED]
        return np.maximum((w @ net.p["filters"]).max(axis=1) + net.p["bias"], 0)

    grads = net.gradients(docs, labels)
    for name, at in (("base", (0,)), ("mean", (3,)), ("max", (5,)), ("bias", (2,)), ("filters", (7, 3)), ("embed", (100, 1))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        up = loss()
        net.p[name][at] = old - 1e-4
        down = loss()
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=1e-4), name


def test_edges(docs, rows, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.digests(docs, labels, 0.3).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in Q.digests(docs, one, 0.3).collect())
    assert Q.digests(none, labels, 0.3).collect() == []


def plain_score(net, data):
    """The network by plain loops over chunks, filters, places, bytes and embedding numbers."""
    p = net.p
    n = max(1, -(-len(data) // Q.CHUNK))
    padded = data + bytes(n * Q.CHUNK + Q.WIDTH - 1 - len(data))
    total, most = [0.0] * Q.FILTERS, [0.0] * Q.FILTERS
    for c in range(n):
        for f in range(Q.FILTERS):
            best = -1e9
            for at in range(c * Q.CHUNK, (c + 1) * Q.CHUNK):
                z = 0.0
                for j in range(Q.WIDTH):
                    for e in range(Q.EMBED):
                        z += float(p["embed"][padded[at + j]][e]) * float(p["filters"][j * Q.EMBED + e][f])
                best = max(best, z)
            pooled = max(0.0, best + float(p["bias"][f]))
            total[f] += pooled
            most[f] = max(most[f], pooled)
    logit = float(p["base"][0]) + sum(t / n * float(a) + m * float(b) for t, m, a, b in zip(total, most, p["mean"], p["max"]))
    return 1 / (1 + np.exp(-logit))


def test_scores_equal_plain_loops():
    net = Q.Network(0.6)
    data = [b"", b"one two", "é日 long ".encode() * 40]
    assert np.allclose(net.scores(data), [plain_score(net, d) for d in data], atol=1e-5)


def test_texts_of_the_sample_are_whole_and_long_ones_are_not_in_it(spark):
    rows = [(1, "a" * 20_000), (2, "b" * (Q.SAMPLE_CHUNKS * Q.CHUNK + 1)), (3, None), (4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, quality int")
    in_it = {k for k, t in rows if zlib.crc32(str(k).encode()) % 5 and len(t or "") <= Q.SAMPLE_CHUNKS * Q.CHUNK}
    chunks, _ = Q.sample(docs, labels)
    assert sorted(map(len, chunks)) == sorted(max(1, -(-len(t or "") // Q.CHUNK)) for k, t in rows if k in in_it)
