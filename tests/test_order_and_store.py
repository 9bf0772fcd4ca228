"""Order at any magnitude, zero norms, stored indexes, hot terms, null keys, staging, clean-up."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from rankfuse.functions import stats as st
from rankfuse.operators import evaluate as ev
from rankfuse.operators import features as fe
from rankfuse.operators import graph as gr
from rankfuse.operators import ordering as od
from rankfuse.operators import search as se
from rankfuse.session import ensure_checkpoint_dir
from rankfuse.sources import io, testdata


@pytest.mark.parametrize("unit", [1e-7, 1e-11, 1e-14])
def test_order_does_not_depend_on_the_magnitude(spark, unit):
    ranks = spark.createDataFrame([(f"d{k:02d}", unit * (1 + k / 1000)) for k in range(20)], "id string, rank double")
    best = [f"d{k}" for k in (19, 18, 17)]
    assert [r.id for r in gr.top_ranked(ranks, 3).collect()] == best
    top = od.top_fraction(ranks, [gr.rank_key().desc(), F.col("id").asc()], 0.15)
    assert [r.id for r in top.orderBy("pos").collect()] == best
    scored = ranks.select(F.lit("q").alias("query_id"), "id", F.lit(0.0).alias("lex"), F.col("rank").alias("pr"))
    sweep = ev.alpha_sweep(scored, [0.0, 1e-6], 3).where("alpha = 0").orderBy("pos")
    assert [r.id for r in sweep.collect()] == best
    targets = spark.createDataFrame([("q", "d16")], "query_id string, target_id string")
    assert se.position_of(scored, targets, [0.0]).first()["size"] == 4
    index = fe.build_tfidf(ranks.select("id", F.lit("word").alias("title")), ranks)
    got = se.search_topk(se.one_query(spark, "other"), index, 3, 1.0, 1.0).orderBy("pos").collect()
    assert [r.id for r in got] == best


def test_noise_of_summation_is_a_tie(spark):
    a, b = 0.1 + 0.2, 0.3
    rows = spark.createDataFrame([("x", a), ("a", b)], "id string, rank double")
    assert a != b and [r.id for r in gr.top_ranked(rows, 2).collect()] == ["a", "x"]
    (r,) = spark.createDataFrame([(0.0, -2.5)], "z double, n double").select(od.significant(F.col("z")).alias("z"), od.significant(F.col("n")).alias("n")).collect()
    assert (r.z, r.n) == (0.0, -2.5)


@pytest.mark.parametrize("texts", [("red", "red"), ("red", "red blue")])
def test_words_of_all_documents_have_no_norm(spark, texts):
    papers = spark.createDataFrame(list(zip("ab", texts)), "id string, title string")
    index = fe.build_tfidf(papers)
    got = {r.id: r.cosine for r in se.score_documents(spark, "red", index).collect()}
    assert got == {"a": 0.0, "b": 0.0}
    ranked = se.full_ranking(spark, "blue", index, papers).collect()
    assert [r.id for r in ranked] == (["b", "a"] if "blue" in texts[1] else ["a", "b"])
    assert [r.title for r in ranked] == [dict(zip("ab", texts))[r.id] for r in ranked]
    assert se.search_topk(se.one_query(spark, "red"), index, 5).count() == 2


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(f"p{k:03d}", f"common word{k % 7} word{k % 11} tail{k}") for k in range(120)]
    return spark.createDataFrame(rows, "id string, title string")


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_stored_index_equals_the_lazy_one(spark, papers, tmp_path):
    store = str(tmp_path / "index")
    ranks = papers.select("id", (F.length("title") / 1000.0).alias("rank"))
    lazy, kept = fe.build_tfidf(papers, ranks), fe.build_tfidf(papers, ranks, store=store)
    queries = spark.createDataFrame([("q1", "common word3"), ("q2", "tail5 word1 nothing")], "query_id string, query string")
    for table in ("weights", "norms", "postings"):
        assert rows_of(getattr(lazy, table)) == rows_of(getattr(kept, table))
    assert rows_of(se.search_topk(queries, lazy, 9, 1.0, 0.5)) == rows_of(se.search_topk(queries, kept, 9, 1.0, 0.5))
    b_lazy, b_kept = fe.build_bm25(papers, ranks), fe.build_bm25(papers, ranks, store=store)
    assert rows_of(se.bm25_scores(queries, b_lazy)) == rows_of(se.bm25_scores(queries, b_kept))
    assert rows_of(se.match_any(queries, b_lazy)) == rows_of(se.match_any(queries, b_kept))
    plan = fe.tfidf_lookup(kept, "p007")._jdf.queryExecution().toString()
    assert "EqualTo(id,p007)" in plan
    assert fe.tfidf_lookup(kept, "p007", required=True).count() == 4
    with pytest.raises(LookupError):
        fe.tfidf_lookup(kept, "nope", required=True)
    new = {r.term: (r.tf, r.weight) for r in fe.tfidf_vector(spark, "common common unseen", kept).collect()}
    assert new["common"] == (2, 0.0) and new["unseen"] == (1, pytest.approx(math.log(121)))


def test_hot_terms_are_spread_by_plan(spark, papers):
    docs = papers.withColumn("title", F.concat("title", F.lit(" hot")))
    terms = fe.doc_terms(docs)
    vocab = fe.vocabulary(terms, 120)
    hot = od.hot_keys(vocab, "term", "df", 8)
    assert {r.term for r in hot.collect()} >= {"common", "hot"} and hot.count() < 8
    off = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = fe.tfidf_weights(terms, vocab, hot)
        plan = spread._jdf.queryExecution().toString()
        assert "__salt" in plan
        assert rows_of(spread) == rows_of(fe.tfidf_weights(terms, vocab))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", off)


def test_null_group_keys_keep_their_statistics(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("k", 5.0), ("k", None)], "k string, v double")
    got = {r.k: r.v_median for r in st.stats_by_key(df, "v", ["k"]).collect()}
    assert got == {None: 2.0, "k": 5.0}
    box = {r.k: (r.q1, r.median, r.q3) for r in st.box_stats(df, "v", ["k"]).collect()}
    assert box == {None: (1.5, 2.0, 2.5), "k": (5.0, 5.0, 5.0)}
    empty = df.limit(0)
    assert st.box_stats(empty, "v", ["k"]).collect() == []
    (r,) = st.box_stats(empty, "v").collect()
    assert r.median is None and r.whisker_lo is None


def test_null_struct_stays_null(spark):
    df = spark.sql("SELECT CAST(NULL AS STRUCT<x: DECIMAL(5,2)>) AS s UNION ALL SELECT named_struct('x', CAST(1.5 AS DECIMAL(5,2)))")
    got = [r.s if r.s is None else r.s.x for r in io.decimal_to_double(df).collect()]
    assert sorted(got, key=str) == [1.5, None]


def test_json_without_a_required_field(spark, tmp_path):
    spark.createDataFrame([("1", "t", ["2"])], "id string, title string, references array<string>").write.json(str(tmp_path / "ok"))
    assert io.read_corpus_json(spark, str(tmp_path / "ok")).count() == 1
    spark.createDataFrame([("1", ["2"])], "id string, references array<string>").write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="title"):
        io.read_corpus_json(spark, str(tmp_path / "bad"))


def test_unfinished_stage_is_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(49).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert io.stage_once(spark, path, lambda: spark.range(100)).count() == 100
    assert io.stage_once(spark, path, lambda: spark.range(5)).count() == 100


def test_head_to_an_existing_path_is_an_error(spark, papers, tmp_path):
    path = str(tmp_path / "head")
    io.write_head(papers, path, 7)
    assert spark.read.parquet(path).count() == 7
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        io.write_head(papers, path, 7)


def test_pagerank_leaves_one_state(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    edges = spark.createDataFrame([(f"n{k}", f"n{(k * 7) % 30}") for k in range(30)] * 2, "src string, dst string")
    for every in (1, 2, 3):
        before = set(glob.glob(f"{root}/rdd-*"))
        res = gr.pagerank(edges, max_iter=7, tol=None, checkpoint_interval=every)
        assert len(set(glob.glob(f"{root}/rdd-*")) - before) <= 2
        assert res.ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        gr.pagerank(edges, checkpoint_interval=4)
    before = set(glob.glob(f"{root}/rdd-*")), set(glob.glob(f"{root}/rankfuse-io-*/pagerank-*"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    hub = spark.createDataFrame([("hub", f"n{k}") for k in range(60)] + [(f"n{k}", "hub") for k in range(5)], "src string, dst string")
    assert gr.pagerank(hub, hub.select(F.col("dst").alias("id")), max_iter=4, tol=None).ranks.count() == 61
    assert set(glob.glob(f"{root}/rdd-*")) == before[0]
    assert set(glob.glob(f"{root}/rankfuse-io-*/pagerank-*")) == before[1]
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive


def test_scratch_is_released(spark):
    path = io.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    io.release(spark)
    assert not glob.glob(path.removeprefix("file:") + "*")


def test_subsets_of_several_sizes(spark):
    papers = spark.createDataFrame([(str(k), f"t{k}") for k in range(6)], "id string, title string")
    ranks = spark.createDataFrame([(str(k), 1.0 + k) for k in range(6)], "id string, rank double")
    edges = spark.createDataFrame([("5", "4"), ("5", "4"), ("4", "3"), ("0", "5"), ("5", "x")], "src string, dst string")
    subs = gr.corpus_subsets_by_rank(papers, edges, ranks, [2, 4])
    got = {n: (sorted(r.id for r in p.collect()), sorted(map(tuple, e.collect()))) for n, (p, e) in subs.items()}
    assert got == {2: (["4", "5"], [("5", "4")] * 2), 4: (["2", "3", "4", "5"], [("4", "3")] + [("5", "4")] * 2)}


def test_lookup_of_an_unknown_paper_is_an_error(spark):
    sf = "/root/testdata/sf0.001"
    assert testdata.paper_or_error(spark, sf, "7").count() == 1
    for unknown in ("999999999", "x7", "007"):
        with pytest.raises(LookupError):
            testdata.paper_or_error(spark, sf, unknown)


def test_titled_ranks_in_order(spark):
    papers = spark.createDataFrame([(str(k), f"t{k}") for k in range(5)], "id string, title string")
    ranks = spark.createDataFrame([("0", 0.2), ("1", 0.5), ("2", 0.2), ("x", 0.9), ("4", 1e-9)], "id string, rank double")
    assert [r.id for r in gr.titled_ranks(ranks, papers, sort=True).collect()] == ["1", "0", "2", "4"]
