import hashlib
import re
from collections import Counter, defaultdict

import pytest

from rankfuse.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups(docs, rows, none):
    members = defaultdict(list)
    for r in rows:
        members[norm(r[1])].append(r[0])
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = next(m for t, m in members.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids)
        assert r.kept is False or r.doc_id == r.keep_id
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(members)
    assert exact_dedup.groups(none).collect() == []


@pytest.mark.parametrize("sent", [1 << 18, -1])
def test_dedup_keeps_whole_rows(docs, rows, none, monkeypatch, sent):
    monkeypatch.setattr(exact_dedup, "KEYS_SENT", sent)  # beyond it every text is hashed
    out = exact_dedup.dedup(docs)
    assert out.schema == docs.schema
    best = {}
    for r in rows:
        key = (r[0] is None, r[0] if r[0] is not None else 0)
        best[norm(r[1])] = min(best.get(norm(r[1]), key), key)
    got = {norm(r.text): (r.doc_id is None, r.doc_id or 0) for r in out.collect()}
    assert got == best and out.count() == len(best)
    assert exact_dedup.dedup(none).collect() == []


def test_full_hash_only_where_prefix_and_length_agree(docs):
    rows = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id AS id", "text")
    unique = exact_dedup.refine(rows).where("group_size = 1").collect()
    assert any(r.sha is None for r in unique)


def test_same_length_and_prefix_but_other_text(spark):
    stem = "p" * 80
    df = spark.createDataFrame([(1, stem + "a"), (2, stem + "b"), (3, stem + "a")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(df).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}


def test_plan_has_no_python(docs):
    plan = exact_dedup.groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
