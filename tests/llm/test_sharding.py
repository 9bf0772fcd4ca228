import random
import zlib
from collections import defaultdict

import pytest

from rankfuse.llm import flow, sharding


def test_rows(docs, rows, none):
    got = sharding.digests(docs, 4).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    want = sorted((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in by[s]) - total / 4) <= 2 * largest for s in range(4))
    assert sharding.digests(none, 4).collect() == []


def test_near_equal_sizes_and_reruns(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, "x" * rnd.randrange(200)) for k in range(20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    a = sharding.digests(docs, 40).collect()
    by = defaultdict(int)
    for r in a:
        by[r.shard] += r["size"]
    assert len(by) == 40 and max(by.values()) - min(by.values()) <= 4 * 216
    assert sorted(map(str, a)) == sorted(map(str, sharding.digests(docs, 40).collect()))


def test_runs_change_nothing(docs, monkeypatch):
    a = sorted(map(str, sharding.digests(docs, 3).collect()))
    monkeypatch.setattr(sharding, "RUN_ROWS", 2)
    assert a == sorted(map(str, sharding.digests(docs, 3).collect()))


@pytest.mark.parametrize("seed", range(30))
def test_transfers_move_the_fewest_bytes(seed):
    rnd = random.Random(seed)
    old = [rnd.randrange(100) for _ in range(rnd.randrange(1, 12))]
    new = sharding.capacities(sum(old), rnd.randrange(1, 9))
    blocks = flow.transfers(old, new)
    assert [sum(b for _, b in parts) for parts in blocks] == old
    into = [0] * len(new)
    stay = 0
    for i, parts in enumerate(blocks):
        for j, b in parts:
            into[j] += b
            stay += b * (i == j)
    assert into == new and stay == sum(map(min, old, new))


@pytest.mark.parametrize("seed", range(20))
def test_flow_costs_against_bellman_ford(seed):
    rnd = random.Random(seed)
    n = 6
    edges = [(a, b, rnd.randrange(1, 6), rnd.randrange(5)) for a in range(n) for b in range(n) if a != b and rnd.random() < 0.5]
    net = flow.Network(n)
    ids = [net.edge(*e) for e in edges]
    sent = net.solve(0, n - 1)
    cost = sum(net.used(i) * e[3] for i, e in zip(ids, edges))
    # successive single paths by Bellman-Ford
    room = {}
    for a, b, r, c in edges:
        room.setdefault((a, b, c), 0)
        room[a, b, c] += r
    flowed = plain = 0
    while True:
        far, via = [float("inf")] * n, [None] * n
        far[0] = 0
        for _ in range(n):
            for (a, b, c), r in room.items():
                if r and far[a] + c < far[b]:
                    far[b], via[b] = far[a] + c, (a, b, c)
        if far[-1] == float("inf"):
            break
        v, plain, flowed = n - 1, plain + far[-1], flowed + 1
        while v:
            a, b, c = via[v]
            room[a, b, c] -= 1
            room[b, a, -c] = room.get((b, a, -c), 0) + 1
            v = a
    assert (sent, cost) == (flowed, plain)


def test_rewrite_writes_changed_shards_only(spark, tmp_path):
    old = tmp_path / "old"
    for k, n in enumerate((10, 10, 30, 10)):
        spark.createDataFrame([(100 * k + i, "abcd", k) for i in range(n)], "doc_id long, text string, shard int").coalesce(1).write.mode("append").parquet(str(old / f"part={k}"))
    docs = spark.read.parquet(*[str(old / f"part={k}") for k in range(4)])
    affected = sharding.rewrite(docs, str(tmp_path / "new"), 4)
    assert affected == [0, 1, 2, 3]
    back = spark.read.parquet(str(tmp_path / "new"))
    assert back.count() == 60 and {r["count"] for r in back.groupBy("shard").count().collect()} == {15}
    same = spark.read.parquet(*[str(old / f"part={k}") for k in (0, 1, 3)])
    assert sharding.rewrite(same, str(tmp_path / "none"), 3) == []


def test_digests_are_of_written_shards(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "x" * (k % 50)) for k in range(500)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(sharding.common, "scratch_root", lambda _: str(tmp_path / "scratch"))
    got = sharding.digests(spark.read.parquet(str(tmp_path / "d")), 6).collect()
    (path,) = (tmp_path / "scratch").glob("shards-*")
    files = spark.read.parquet(str(path)).collect()
    assert sorted((r.doc_id, len(r.text) + 16, r.shard, r.slot) for r in files) == sorted((r.doc_id, r["size"], r.shard, r.slot) for r in got)
    assert len({r.shard for r in files}) == 6


def test_shards_that_stay_are_read_where_they_are(spark, tmp_path):
    for k, n in enumerate((10, 10, 12, 8)):
        spark.createDataFrame([(100 * k + i, "abcd") for i in range(n)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"old/part={k}"))
    docs = spark.read.parquet(*[str(tmp_path / f"old/part={k}") for k in range(4)])
    affected, rows = sharding.reshard(docs, str(tmp_path / "new"), 4)
    assert affected == [2, 3] and {r.shard for r in spark.read.parquet(str(tmp_path / "new")).collect()} == {2, 3}
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in docs.collect())
    assert {(r.shard, r["count"]) for r in rows.groupBy("shard").count().collect()} == {(k, 10) for k in range(4)}
