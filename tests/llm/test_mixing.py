import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankfuse.llm import common, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, weights, limit=3):
    """Targets by repeated resharing, as the definition has it."""
    total, full, left = sum(sizes), {}, dict(enumerate(sizes))
    while left:
        room = total - sum(full.values())
        share = {k: room * weights[k] / sum(weights[j] for j in left) for k in left}
        over = [k for k in left if share[k] > limit * sizes[k]]
        if not over:
            return [full.get(k, share.get(k)) for k in range(len(sizes))]
        for k in over:
            full[k] = limit * sizes[k]
            del left[k]
    return [full[k] for k in range(len(sizes))]


def test_rows(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    targets = dict(zip(order, reshared([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    source = {r[0]: r[3] for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        if r.doc_id is None:
            continue
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(targets[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert (r.first_position is not None) == (r.taken > 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in ("a", "b", "hot", "\U0001f600", "￿"):
        assert abs(taken[s] - targets[s]) <= largest[s] / 2
    assert sum(targets.values()) == pytest.approx(sum(size.values()))
    assert mixing.mix(none).collect() == []


def test_reruns_and_partitions_agree(docs):
    a = sorted(map(str, mixing.mix(docs).collect()))
    assert a == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_buckets_change_nothing(docs, monkeypatch):
    a = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert a == sorted(map(str, mixing.mix(docs).collect()))


def test_curriculum_repeats_whole_rows_in_order(docs, rows, none):
    out = mixing.curriculum(docs)
    assert out.schema == docs.schema
    repeats = Counter()
    for r in mixing.mix(docs).where("taken > 0 AND doc_id IS NOT NULL").collect():
        repeats[r.doc_id] += r.taken // r["size"]
    got = out.collect()
    assert Counter(r.doc_id for r in got if r.doc_id is not None) == repeats
    assert {r.text for r in got} <= {r[1] for r in rows}
    assert mixing.curriculum(none).collect() == []


def test_inverse_of_the_integral(spark):
    knots = ((0.0, 1.0), (0.25, 4.0), (0.5, 0.0), (1.0, 2.0))
    df = spark.range(101).select((F.col("id") / 100.0).alias("u"))
    whole = mixing.integral(knots)

    def area(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(t, t0), t1) - t0
            out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out

    for r in df.select("u", mixing.inverse(knots, F.col("u")).alias("t")).collect():
        assert area(r.t) / whole == pytest.approx(r.u, abs=1e-9)


def test_instant_mixture_follows_the_schedule(spark):
    rows = [(k, " ".join(["w"] * 10), f"s{k % 3}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan(common.stage(mixing.sizes(docs, F.col("doc_id")), "t"))
    at = planned.select("source", F.explode("positions").alias("t"))
    early = {r.source: r["count"] for r in at.where("t < 0.1").groupBy("source").count().collect()}
    late = {r.source: r["count"] for r in at.where("t >= 0.9").groupBy("source").count().collect()}
    whole = {r.source: r["count"] for r in at.groupBy("source").count().collect()}
    assert early["s0"] / whole["s0"] == pytest.approx(0.1 * 5.9 / 5, rel=0.05)
    assert late["s2"] / whole["s2"] == pytest.approx(0.1 * 1.45, rel=0.1)


def test_one_source_and_native(spark, docs):
    df = spark.createDataFrame([(k, "a b c", "only") for k in range(5)], "doc_id long, text string, source string")
    assert all(r.taken == r["size"] == 3 for r in mixing.mix(df).collect())
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
