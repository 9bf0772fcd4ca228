"""Indexes as artefacts: opening by path, keys, hot terms in files, block bounds, segments."""

import glob
import json
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankfuse.operators import features as fe
from rankfuse.operators import search as se
from rankfuse.operators.segments import SegmentedIndex
from rankfuse.session import write_file
from rankfuse.sources import io


def corpus(n, seed, first=0):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    return [(f"p{k:04d}", " ".join(rnd.choices(words, weights=[1 / (j + 1) for j in range(200)], k=rnd.randrange(1, 60)))) for k in range(first, first + n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, title string")


def rows_of(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def papers(spark):
    return frame(spark, corpus(400, 1) + [("empty", ""), ("stop", "the of and")])


@pytest.fixture(scope="module")
def ranks(papers):
    return papers.where("id <> 'p0003'").select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("rank"))


@pytest.fixture(scope="module")
def queries(spark):
    rnd = random.Random(5)
    rows = [(f"q{k}", " ".join(f"w{rnd.randrange(120)}" for _ in range(rnd.randrange(1, 5)))) for k in range(12)]
    return spark.createDataFrame([*rows, ("none", "nothing here"), ("hot", "w0 w0 w1"), ("blank", "")], "query_id string, query string")


@pytest.fixture(scope="module")
def store(spark, papers, ranks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    fe.build_tfidf(papers, ranks, store=path)
    fe.build_bm25(papers, ranks, store=path)
    return path


def test_open_needs_only_the_path(spark, papers, ranks, queries, store):
    tf, bm = fe.open_tfidf(spark, store), fe.open_bm25(spark, store)
    lazy_tf, lazy_bm = fe.build_tfidf(papers, ranks), fe.build_bm25(papers, ranks)
    for name in ("terms", "vocab", "weights", "norms", "postings", "docs"):
        assert rows_of(getattr(tf, name)) == rows_of(getattr(lazy_tf, name)), name
    assert (tf.n_docs, bm.n_docs, round(bm.avg_len, 9)) == (lazy_tf.n_docs, lazy_bm.n_docs, round(lazy_bm.avg_len, 9))
    assert rows_of(se.search_topk(queries, tf, 7, 1.0, 0.5)) == rows_of(se.search_topk(queries, lazy_tf, 7, 1.0, 0.5))
    assert rows_of(se.bm25_scores(queries, bm)) == rows_of(se.bm25_scores(queries, lazy_bm))
    assert rows_of(se.match_any(queries, bm)) == rows_of(se.match_any(queries, lazy_bm))
    assert "EqualTo(id,p0007)" in fe.tfidf_lookup(tf, "p0007")._jdf.queryExecution().toString()
    assert {r.term for r in fe.tfidf_vector(spark, "w3 unseen", tf).collect()} == {"w3", "unseen"}


def test_unfinished_or_foreign_indexes_do_not_open(spark, store, tmp_path):
    with pytest.raises(FileNotFoundError):
        fe.open_tfidf(spark, str(tmp_path / "nothing"))
    facts = json.loads(open(f"{store}/manifest-tfidf.json").read())
    write_file(spark, str(tmp_path / "manifest-tfidf.json"), json.dumps({**facts, "analyzer": "other"}).encode())
    with pytest.raises(ValueError, match="analyzer"):
        fe.open_tfidf(spark, str(tmp_path))


def test_tables_of_another_key_are_written_again(spark, tmp_path):
    path = str(tmp_path / "i")
    one = fe.build_bm25(frame(spark, [("a", "red")]), store=path, key="1")
    assert rows_of(one.terms) == [("a", "red", 1)]
    fe.build_bm25(frame(spark, [("b", "blue blue")]), store=path, key="2")
    assert rows_of(fe.open_bm25(spark, path).terms) == [("b", "blue", 2)]
    same = fe.build_bm25(frame(spark, [("c", "never read")]), store=path, key="2")
    assert rows_of(same.terms) == [("b", "blue", 2)]


def test_a_hot_term_is_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(20000).select(F.format_string("d%05d", "id").alias("id"), F.when(F.col("id") % 5 < 3, F.lit("hot")).otherwise(
        F.concat(F.lit("w"), F.col("id").cast("string"))).alias("title"))
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        fe.build_tfidf(docs, store=str(tmp_path))
    finally:
        spark.conf.set(adaptive, before)
    files = [pq.read_table(f).column("term").to_pylist() for f in glob.glob(f"{tmp_path}/postings/*.parquet")]
    share = 20000 / len(files)
    assert len(files) >= 4 and max(len(f) for f in files) < 2 * share
    assert sum("hot" in f for f in files) >= 2


@pytest.mark.parametrize("alpha, n", [(0.5, 1), (0.5, 10), (1.0, 5), (0.0, 5), (0.9, 1000)])
def test_pruned_search_equals_scoring_all(spark, queries, store, alpha, n):
    bm = fe.open_bm25(spark, store)
    got = se.pruned_topk(queries, bm, alpha, n)
    assert rows_of(got.top) == rows_of(se.bm25_hybrid_topk(queries, bm, alpha, n))
    matches = fe.query_terms(queries).join(bm.postings, "term").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    assert rows_of(got.cells.groupBy("query_id").agg(F.sum("n").alias("n"))) == rows_of(matches)


def test_pruned_search_skips_postings(spark, tmp_path):
    path = str(tmp_path / "i")
    fe.build_bm25(frame(spark, corpus(6000, 3)), store=path)
    bm = fe.open_bm25(spark, path)
    queries = spark.createDataFrame([("a", "w150 w0"), ("b", "w120 w3 w160"), ("c", "w90 w1")], "query_id string, query string")
    got = se.pruned_topk(queries, bm, 1.0, 5)
    work = got.cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("scored"), F.col("n"))).alias("scored")).first()
    assert work["scored"] < 0.6 * work["all"]
    assert rows_of(got.top) == rows_of(se.bm25_hybrid_topk(queries, bm, 1.0, 5))


def pinned(scored, pick):
    """One target a query by score, as given rows: of ties, another run could pick another one."""
    rows = scored.groupBy("query_id").agg(pick("id", "lex").alias("target_id")).collect()
    return scored.sparkSession.createDataFrame(rows, "query_id string, target_id string")


@pytest.mark.parametrize("alphas", [[0.0, 0.3, 1.0], [0.7]])
def test_positions_by_blocks_equal_those_of_all_matches(spark, papers, queries, store, alphas):
    bm = fe.open_bm25(spark, store)
    scored = se.bm25_scores(queries, bm)
    some = scored.groupBy("query_id").agg(F.max_by("id", F.xxhash64("id")).alias("target_id"))  # any match
    best = pinned(scored, F.max_by)
    absent = queries.select("query_id", F.lit("p0001").alias("target_id"))  # matches some, not others
    for targets in (some, best, absent, absent.where(F.lit(False))):
        got = se.positions_by_blocks(queries, targets, bm, alphas)
        want = rows_of(se.position_of(scored, targets, alphas).fillna(-1), "query_id", "alpha", "size")
        assert rows_of(got.sizes.fillna(-1), "query_id", "alpha", "size") == want
        assert got.sizes.columns == ["query_id", "alpha", "size"]


def test_positions_by_blocks_leave_blocks_closed(spark, tmp_path):
    path = str(tmp_path / "i")
    fe.build_bm25(frame(spark, corpus(6000, 3)), store=path)
    bm = fe.open_bm25(spark, path)
    queries = spark.createDataFrame([("a", "w0"), ("b", "w120 w3 w160"), ("c", "w90 w1")], "query_id string, query string")
    scored = se.bm25_scores(queries, bm)
    best, worst = pinned(scored, F.max_by), pinned(scored, F.min_by)
    for targets, query in ((best, "a"), (best, "b"), (worst, "a")):  # counted as below, as below, and as above
        got = se.positions_by_blocks(queries, targets, bm, [1.0])
        assert rows_of(got.sizes) == rows_of(se.position_of(scored, targets, [1.0]))
        work = got.cells.where(F.col("query_id") == query).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("opened"), F.col("n"))).alias("opened")).first()
        assert (work["opened"] or 0) < 0.5 * work["all"], (query, work)


def test_positions_by_blocks_shuffle_no_matches_by_query(spark, queries, store):
    bm = fe.open_bm25(spark, store)
    targets = queries.select("query_id", F.lit("p0001").alias("target_id"))
    got = se.positions_by_blocks(queries, targets, bm, [0.5])
    plan = got.sizes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [query_id" in plan
    with pytest.raises(ValueError, match="alphas"):
        se.positions_by_blocks(queries, targets, bm, [0.5, 1.5])


def test_pruned_search_needs_bounds_and_a_blend(spark, papers, queries, store):
    with pytest.raises(ValueError, match="store"):
        se.pruned_topk(queries, fe.build_bm25(papers))
    with pytest.raises(ValueError, match="alpha"):
        se.pruned_topk(queries, fe.open_bm25(spark, store), 1.5)


def same_as_rebuild(spark, index, living, queries):
    docs = frame(spark, sorted(living.items()))
    want = fe.count_terms(docs)
    have = index.counts()
    for name in ("terms", "df", "lengths"):
        assert rows_of(getattr(have, name), *getattr(want, name).columns) == rows_of(getattr(want, name)), name
    assert (have.n_docs, have.total_len) == (want.n_docs, want.total_len)
    assert rows_of(se.bm25_hybrid_topk(queries, index.bm25(), 1.0, 5)) == rows_of(se.bm25_hybrid_topk(queries, fe.build_bm25(docs), 1.0, 5))


def test_segments_equal_a_rebuild(spark, queries, tmp_path):
    path, living = str(tmp_path / "s"), {}
    index = SegmentedIndex(spark, path)
    assert index.counts().n_docs == 0 and index.terms().count() == 0
    first = corpus(60, 1)
    index.upsert(frame(spark, [*first, (None, "x"), ("nul", None)]))
    living |= dict(first)
    same_as_rebuild(spark, index, living, queries)
    second = [(k, t + " w199 w199") for k, t in corpus(20, 7)] + corpus(10, 8, first=500)
    index.upsert(frame(spark, second))
    living |= dict(second)
    index.delete(spark.createDataFrame([("p0002",), ("p0050",), ("unknown",)], "id string"))
    for k in ("p0002", "p0050"):
        del living[k]
    same_as_rebuild(spark, SegmentedIndex(spark, path), living, queries)
    index.upsert(frame(spark, [("p0002", "back again w5")]))  # what was deleted can come back
    living["p0002"] = "back again w5"
    same_as_rebuild(spark, index, living, queries)
    before = index.facts["version"]
    index.merge()
    assert len(index.facts["segments"]) == 1 and index.facts["version"] == before + 1
    same_as_rebuild(spark, SegmentedIndex(spark, path), living, queries)
    index.clean()
    assert len(glob.glob(f"{path}/terms/*")) == 1 and len(glob.glob(f"{path}/versions/*.json")) == 1
    index.delete(frame(spark, list(living.items())).select("id"))
    assert (index.counts().n_docs, index.frequencies().count(), index.lengths().count()) == (0, 0, 0)


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = SegmentedIndex(spark, path), SegmentedIndex(spark, path)
    one.upsert(frame(spark, [("a", "red")]))
    with pytest.raises(FileExistsError):
        two.upsert(frame(spark, [("b", "blue")]))
    again = SegmentedIndex(spark, path)
    again.upsert(frame(spark, [("b", "blue")]))
    assert rows_of(again.terms()) == [("a", "red", 1), ("b", "blue", 1)]


def test_large_corpora_get_more_tasks_and_equal_tables(spark, papers, ranks, tmp_path, monkeypatch):
    """Work per task is bounded by counted rows and text, whatever the session's number of partitions."""
    docs, pr = papers, ranks
    plain = fe.build_bm25(docs, pr, store=str(tmp_path / "a")), fe.build_tfidf(docs, pr, store=str(tmp_path / "a"))
    monkeypatch.setattr(fe, "TASK_TEXT", 3000)
    monkeypatch.setattr(fe, "TASK_ROWS", 1000)
    for small in (True, False):
        monkeypatch.setattr(fe, "SMALL_TERMS", 500_000 if small else 0)
        path = str(tmp_path / f"b{small}")
        bm, tf = fe.build_bm25(docs, pr, store=path), fe.build_tfidf(docs, pr, store=path)
        assert fe.text_parts(docs) > 8 and len(glob.glob(f"{path}/terms/*.parquet")) > 8
        for name in ("postings", "blocks", "vocab", "doc_len", "terms"):
            assert rows_of(getattr(bm, name)) == rows_of(getattr(plain[0], name))
        for name in ("weights", "norms", "postings", "docs"):
            assert rows_of(getattr(tf, name)) == rows_of(getattr(plain[1], name))


def test_block_searches_shuffle_no_row_for_a_query_and_block(spark, queries, store):
    bm = fe.open_bm25(spark, store)
    targets = queries.select("query_id", F.lit("p0001").alias("target_id"))
    plans = [se.pruned_topk(queries, bm, 0.5, 5).top, se.positions_by_blocks(queries, targets, bm, [0.5]).sizes]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "position-cells" not in text and not re.search(r"hashpartitioning\(query_id#\d+, (block|id)#", text)


def test_few_query_words_meet_postings_where_these_are(spark, papers):
    docs, asked = papers, spark.createDataFrame([("q", "w1 w2")], "query_id string, query string")
    plan = se.cosine_contribs(asked, fe.build_tfidf(docs))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[term#\d+\], \[term#\d+\], Inner", plan)


def above_counts(plan):
    """The steps that a plan runs on the counts (the scan of a column ``tf`` in buckets), the last one first."""
    lines = plan.splitlines()
    place = lambda line: re.search(r"[A-Za-z*]", line).start()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and re.search(r"\btf#", line) and "Bucketed: true" in line)
    steps, depth = [], place(lines[at])
    for line in reversed(lines[:at]):
        if re.search(r"[A-Za-z]", line) and place(line) < depth:
            steps, depth = [*steps, line], place(line)
    return steps


@pytest.mark.parametrize("small", [500_000, 5])
def test_postings_are_written_where_their_counts_lie(spark, papers, ranks, tmp_path, monkeypatch, small):
    """No table of an index is made by moving all its postings: only those of rare terms meet the vocabulary."""
    plans = {}

    def noted(spark_, path, build, *args, **named):
        df = build()
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        return io.stage_once(spark_, path, lambda: df, *args, **named)

    monkeypatch.setattr(fe, "stage_once", noted)
    monkeypatch.setattr(fe, "SMALL_TERMS", small)
    path = str(tmp_path / "i")
    bm, tf = fe.build_bm25(papers, ranks, store=path), fe.build_tfidf(papers, ranks, store=path)
    for name in ("postings-bm25", "postings"):
        assert not [step for step in above_counts(plans[name]) if "Exchange" in step]
    lazy_bm, lazy_tf = fe.build_bm25(papers, ranks), fe.build_tfidf(papers, ranks)
    columns = lazy_bm.postings.columns
    assert rows_of(bm.postings, *columns) == rows_of(lazy_bm.postings) == rows_of(fe.open_bm25(spark, path).postings, *columns)
    assert rows_of(tf.postings) == rows_of(lazy_tf.postings) == rows_of(fe.open_tfidf(spark, path).postings)
    assert rows_of(tf.weights) == rows_of(lazy_tf.weights)


def test_block_bounds_are_those_of_the_postings(spark, store):
    bm = fe.open_bm25(spark, store)
    want = bm.postings.groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("w"), F.max("pr"), F.min("w"), F.min("pr"))
    assert rows_of(bm.blocks) == rows_of(want) and bm.blocks.count() < bm.postings.count()
    assert bm.postings.groupBy("block").agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0] <= fe.BLOCK_DOCS


def test_the_common_terms_are_few(spark, monkeypatch):
    df = spark.createDataFrame([(f"t{k}", d) for k, d in enumerate([1] * 9 + [2] * 4 + [3] + [8, 9])], "term string, df long")
    for small, least in ((16, 1), (15, 2), (7, 2), (6, 4), (2, 4), (1, 16), (0, 16)):
        monkeypatch.setattr(fe, "SMALL_TERMS", small)
        assert fe.common_from(df) == least
        assert df.where(F.col("df") >= least).count() <= small


def test_matches_of_a_cosine_search_are_not_shuffled_by_query(spark, papers, ranks, queries):
    index = fe.build_tfidf(papers, ranks)
    plan = se.search_topk(queries, index, 5, 1.0, 0.5)._jdf.queryExecution().executedPlan().toString()
    scored = se.cosine_scores(queries, index)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", scored) and "WindowGroupLimit" in plan
    for mode in ("all", "matching"):
        got = se.search_topk(queries, index, 5, 1.0, 0.5, mode)
        every = se.search_topk(queries, index, 10**6, 1.0, 0.5, mode).where("pos <= 5")
        assert rows_of(got) == rows_of(every)


def test_buckets_are_read_by_path_after_another_write(spark, tmp_path):
    path, rows = str(tmp_path / "b"), spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    one = io.stage_buckets(spark, path, lambda: rows.repartition(3, "k"), "k long, id long", "k", 3, ["id"], key="1")
    assert "Exchange" not in one.groupBy("k", "id").count()._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rankfuse_")]
    assert io.stage_buckets(spark, path, lambda: rows.limit(1), "k long, id long", "k", 3, ["id"], key="1").count() == 100
    io.drop_path(spark, path)
    rows.limit(5).write.parquet(path)
    assert io.stage_buckets(spark, path, lambda: rows, "k long, id long", "k", 3, ["id"]).count() == 5


@pytest.mark.parametrize("texts", [[], [("a", "the of and"), ("b", "")]])
def test_a_corpus_without_words_has_an_index(spark, queries, tmp_path, texts):
    docs, path = frame(spark, texts), str(tmp_path / "i")
    fe.build_tfidf(docs, store=path)
    fe.build_bm25(docs, store=path)
    tf, bm = fe.open_tfidf(spark, path), fe.open_bm25(spark, path)
    assert (tf.n_docs, tf.terms.count(), tf.postings.count(), bm.postings.count(), bm.blocks.count()) == (len(texts), 0, 0, 0, 0)
    assert rows_of(tf.docs) == [(i, 0.0) for i, _ in texts] and se.bm25_hybrid_topk(queries, bm, 0.5, 3).count() == 0


def test_block_searches_of_documents_that_come_twice(spark, tmp_path):
    rows = corpus(300, 11)
    docs, path = frame(spark, rows + rows[::3]), str(tmp_path / "i")
    bm = fe.build_bm25(docs, docs.select("id", (F.pmod(F.xxhash64("id"), F.lit(97)) / 970.0).alias("rank")).distinct(), store=path)
    queries = spark.createDataFrame([(k, " ".join(t.split()[:4])) for k, t in rows[::7]], "query_id string, query string")
    targets, alphas = queries.select("query_id", F.col("query_id").alias("target_id")), [0.0, 0.4, 1.0]
    got = se.positions_by_blocks(queries, targets, bm, alphas).sizes
    assert rows_of(got) == rows_of(se.position_of(se.bm25_scores(queries, bm), targets, alphas))
    for alpha in (0.3, 1.0):
        assert rows_of(se.pruned_topk(queries, bm, alpha, 5).top) == rows_of(se.bm25_hybrid_topk(queries, bm, alpha, 5))
