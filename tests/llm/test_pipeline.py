import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as vocabularies
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from rankfuse.llm import bpe
from rankfuse.llm.queries import BPE_RANKS
from rankfuse.llm.simhash import united

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint_bits(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[j : j + 4]) for j in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def reshared(sizes, weights, limit=3):
    total, full, left = sum(sizes), {}, dict(enumerate(sizes))
    while left:
        room, heavy = total - sum(full.values()), sum(weights[j] for j in left)
        over = [k for k in left if room * weights[k] / heavy > limit * sizes[k]]
        if not over:
            return [full.get(k, room * weights[k] / heavy) for k in range(len(sizes))]
        for k in over:
            full[k] = limit * left.pop(k)
    return [full[k] for k in range(len(sizes))]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_edge_rows_through_all_stages(spark, docs, rows, none, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names; then no rows."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for name, table, html in (("some", docs, pages), ("none", none, pages.limit(0))):
        root = str(tmp_path / name)
        table.write.parquet(f"{root}/documents.parquet")
        html.write.parquet(f"{root}/pages.parquet")
        held = spark.read.parquet(f"{root}/documents.parquet")
        for k, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = step(spark, held, root)
            assert out.columns == docs.columns
            out.write.parquet(f"{root}/{k}")
            held = spark.read.parquet(f"{root}/{k}")
        got = corpus_pipeline.run(spark, root).collect()
        assert len(got) == held.count()
        assert {r.doc_id for r in got} <= {r[0] for r in rows}
        if name == "none":
            assert got == []
        else:
            texts = [r.text for r in held.collect()]
            assert texts and all(t and t.strip() for t in texts)  # what has no letters goes


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert docs.exceptAll(kept).count() == 0


def test_registered():
    queries = entry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in queries)] == []
    assert "pipeline" in queries


def test_rows_against_brute_force(spark):
    """Stage by stage in plain Python; of stage 1 only that it keeps these documents, all of them
    prose with a known language (``test_language`` holds its judgement against the tables)."""
    rows = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]

    best = {}
    for i, text, source in rows:  # exact dedup
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        best[key] = min(best.get(key, (i, text, source)), (i, text, source))
    rows = sorted(best.values())

    prints = np.array([fingerprint_bits(t) for _, t, _ in rows], np.uint64)  # SimHash
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    label = united(len(rows), a, b)
    least = {}
    for row, x in zip(rows, label):
        least[x] = min(least.get(x, row), row)
    rows = sorted(least.values())

    sizes = {i: len(WORD.findall(t)) for i, t, _ in rows}  # mixing
    of = defaultdict(list)
    for i, _, source in rows:
        of[source].append(i)
    order = sorted(of)
    total = {s: sum(sizes[i] for i in of[s]) for s in order}
    targets = reshared([total[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    times = {}
    for s, target in zip(order, targets):
        whole = int(target // total[s])
        before = 0
        for i in sorted(of[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            times[i] = whole + (before + sizes[i] / 2 < target - whole * total[s]) if sizes[i] else 0
            before += sizes[i]

    with open(vocabularies.path(BPE_RANKS), "rb") as f:  # byte-level BPE
        enc = bpe.encoding(f.read(), vocabularies.PATTERN)
    want = []
    for i, text, _ in rows:
        ids = enc.encode_ordinary(text)
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want += [row] * times[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
