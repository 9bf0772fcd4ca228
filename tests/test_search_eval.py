"""Search and evaluation operators against brute force on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfuse.operators import evaluate as ev
from rankfuse.operators import features as fe
from rankfuse.operators import ordering as od
from rankfuse.operators import search as se

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    docs = []
    for i in range(60):
        n = int(rng.integers(0, 12))
        docs.append((f"d{i:02d}", " ".join(rng.choice(WORDS, n)) if i % 17 else "the of and"))
    docs.append(("d98", "alpha beta"))  # exact copies tie on every score
    docs.append(("d99", "alpha beta"))
    papers = spark.createDataFrame(docs, "id string, title string")
    ranks = spark.createDataFrame([(d, float(rng.random()) / 60) for d, _ in docs], "id string, rank double")
    queries = spark.createDataFrame(
        [("q1", "alpha beta"), ("q2", "gamma gamma unknownword"), ("q3", "the of"), ("q4", "kappa")],
        "query_id string, query string")
    return docs, papers, ranks, queries


def analyzed(text):
    from rankfuse.functions.text import ENGLISH_STOP_WORDS
    import re
    t = re.sub(r"[^a-zA-Z0-9\- ]", "", text).lower().split(" ")
    return [w for w in t if w and w not in ENGLISH_STOP_WORDS]


def brute_cosine(docs, ranks, query, alpha, beta):
    n = len(docs)
    tf = {d: {} for d, _ in docs}
    for d, t in docs:
        for w in analyzed(t):
            tf[d][w] = tf[d].get(w, 0) + 1
    df = {}
    for d in tf:
        for w in tf[d]:
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1))
    q = {}
    for w in analyzed(query):
        q[w] = q.get(w, 0) + 1
    qv = {w: c * idf(w) for w, c in q.items()}
    qn = math.sqrt(sum(v * v for v in qv.values()))
    out = []
    for d, _ in docs:
        dv = {w: c * idf(w) for w, c in tf[d].items()}
        dn = math.sqrt(sum(v * v for v in dv.values()))
        cos = sum(qv[w] * dv.get(w, 0.0) for w in qv) / (qn * dn) if qn and dn else 0.0
        out.append((d, alpha * cos + beta * ranks[d]))
    return out


def leading(x):
    m, e = math.frexp(x)
    return math.ldexp(round(m * 2**33), e - 33)


def top_ids(scored, n):
    return [d for d, _ in sorted(scored, key=lambda x: (-leading(x[1]), x[0]))[:n]]


@pytest.mark.parametrize("alpha,beta", [(1.0, 0.0), (1.0, 5.0), (0.0, 1.0)])
def test_search_topk_all_mode_equals_full_scan(spark, corpus, alpha, beta):
    docs, papers, ranks, queries = corpus
    rk = {r.id: r.rank for r in ranks.collect()}
    idx = fe.build_tfidf(papers, ranks)
    got = se.search_topk(queries, idx, 7, alpha, beta).collect()
    for qid, qtext in [("q1", "alpha beta"), ("q2", "gamma gamma unknownword"), ("q3", "the of"), ("q4", "kappa")]:
        mine = [r.id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r.pos)]
        assert mine == top_ids(brute_cosine(docs, rk, qtext, alpha, beta), 7), qid


def brute_bm25(docs, query, k1=1.2, b=0.75):
    toks = {d: analyzed(t) for d, t in docs}
    n = len(docs)
    avg = sum(len(t) for t in toks.values()) / n
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for d, t in toks.items():
        s, hit = 0.0, False
        for w in analyzed(query):
            f = t.count(w)
            if f:
                hit = True
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                s += idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avg))
        if hit:
            out[d] = s
    return out


def test_bm25_scores_and_positions(spark, corpus):
    docs, papers, ranks, queries = corpus
    rk = {r.id: r.rank for r in ranks.collect()}
    idx = fe.build_bm25(papers, ranks)
    scored = se.bm25_scores(queries, idx)
    got = {(r.query_id, r.id): r.lex for r in scored.collect()}
    want_q1 = brute_bm25(docs, "alpha beta")
    assert {d: got[("q1", d)] for d in want_q1} == pytest.approx(want_q1)
    assert not any(k[0] == "q3" for k in got)  # stop words only: no match
    # position of a target document, per alpha, against sorting
    alphas = [0.0, 0.5, 1.0]
    targets = spark.createDataFrame([("q1", "d98"), ("q4", "nope")], "query_id string, target_id string")
    pos = {(r.query_id, r.alpha): r.size for r in se.position_of(scored, targets, alphas).collect()}
    for a in alphas:
        s = [(d, a * v + (1 - a) * rk[d]) for d, v in want_q1.items()]
        assert pos[("q1", a)] == top_ids(s, len(s)).index("d98") + 1
        assert pos[("q4", a)] is None


def brute_difference(r1, r2):
    z = sum(r1.values()) + sum(r2.values())
    if z == 0:
        return 0.0
    keys = set(r1) | set(r2)
    return sum(abs(r1.get(k, 0.0) - r2.get(k, 0.0)) for k in keys) / z


def test_difference_cases(spark):
    mk = lambda rows: spark.createDataFrame(rows, "query_id string, id string, score double")
    a = mk([("q", "x", 1.0), ("q", "y", 2.0)])
    same = ev.resultset_diff(a, a).first().difference
    disjoint = ev.resultset_diff(a, mk([("q", "z", 3.0)])).first().difference
    zero = ev.resultset_diff(mk([("q", "x", 0.0)]), mk([("q", "y", 0.0)])).first().difference
    assert (same, disjoint, zero) == (0.0, 1.0, 0.0)


def test_sweep_and_differences_match_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for q in range(4):
        for d in range(30 + 20 * q):
            rows.append((f"q{q}", f"d{d:03d}", float(rng.random() * 10), float(rng.random() / 50)))
    scored = spark.createDataFrame(rows, "query_id string, id string, lex double, pr double")
    queries = spark.createDataFrame([(f"q{q}", "") for q in range(5)], "query_id string, query string")  # q4: none
    alphas = [float(a) for a in np.geomspace(1e-3, 1, 9)]
    n = 6
    sweep = ev.alpha_sweep(scored, alphas, n)
    plain = ev.alpha_sweep(scored, alphas, n, prefilter=False)
    key = ["query_id", "alpha", "id", "pos"]
    assert sweep.select(*key).exceptAll(plain.select(*key)).count() == 0
    assert plain.select(*key).exceptAll(sweep.select(*key)).count() == 0
    res = {}
    for r in sweep.collect():
        res.setdefault((r.query_id, r.alpha), {})[r.id] = r.score
    for q in range(5):
        for a in alphas:
            sc = [(d, a * l + (1 - a) * p) for qq, d, l, p in rows if qq == f"q{q}"]
            want = top_ids(sc, n)
            assert sorted(res.get((f"q{q}", a), {})) == sorted(want)
    diffs = {(r.query_id, r.alpha1, r.alpha2): r.difference for r in ev.alpha_differences(sweep, queries, alphas).collect()}
    joined = {(r.query_id, r.alpha1, r.alpha2): r.difference
              for r in ev.alpha_differences_join(sweep, queries, alphas).collect()}
    assert len(diffs) == 5 * len(list(itertools.combinations(alphas, 2)))
    for q in range(5):
        for a1, a2 in itertools.combinations(alphas, 2):
            want = brute_difference(res.get((f"q{q}", a1), {}), res.get((f"q{q}", a2), {}))
            assert diffs[(f"q{q}", a1, a2)] == pytest.approx(want, abs=1e-12)
            assert joined[(f"q{q}", a1, a2)] == pytest.approx(want, abs=1e-12)


def test_global_position_and_quantiles_with_hot_group(spark):
    rng = np.random.default_rng(5)
    vals = [("hot", float(v)) for v in rng.normal(size=400)] + [("k1", float(v)) for v in rng.normal(size=7)]
    vals += [("k2", 3.0)]
    df = spark.createDataFrame(vals, "k string, v double").repartition(4)
    pos = od.with_global_position(df.withColumn("u", F.monotonically_increasing_id()),
                                  [F.col("v").asc(), F.col("u").asc()])
    got = [r.v for r in pos.orderBy("pos").collect()]
    assert got == sorted(v for _, v in vals)
    assert [r.pos for r in pos.orderBy("pos").collect()] == list(range(1, len(vals) + 1))
    q = {(r.k, r.p): r.value for r in od.exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["k"]).collect()}
    for k in ["hot", "k1", "k2"]:
        arr = np.array([v for kk, v in vals if kk == k])
        for p in [0.25, 0.5, 0.75]:
            assert q[(k, p)] == pytest.approx(float(np.quantile(arr, p)), abs=1e-12)


def test_top_fraction(spark):
    df = spark.createDataFrame([(f"i{i:02d}", float(i % 7)) for i in range(23)], "id string, r double")
    top = od.top_fraction(df, [F.col("r").desc(), F.col("id").asc()], 0.1)
    want = sorted(((-(i % 7), f"i{i:02d}") for i in range(23)))[:2]
    assert [r.id for r in top.orderBy("pos").collect()] == [w[1] for w in want]


def test_ml_tfidf_matches_exact_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red green blue"), ("b", "red red yellow"), ("c", "blue")],
                                 "id string, title string")
    _, vec = fe.ml_tfidf(docs)
    ml = {r.id: r.norm for r in fe.ml_vector_summary(vec, str(tmp_path / "v")).collect()}
    idx = fe.build_tfidf(docs)
    exact = {r.id: r.norm for r in idx.norms.collect()}
    assert ml == pytest.approx(exact)
