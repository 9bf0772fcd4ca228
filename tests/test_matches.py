"""Matches scored in the tasks that hold the documents, against a row for each query and document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rankfuse.operators import envelope, evaluate, features, matches, search

ALPHAS = [0.0, 0.2, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    words = [f"word{k}" for k in range(30)]
    rows = [(f"{k}", " ".join(rnd.choices(words, range(30, 0, -1), k=rnd.randrange(1, 30)))) for k in range(400)]
    rows += [rows[7], ("é7", rows[8][1]), ("\U0001f6007", rows[8][1])]  # an id that comes twice, ids beyond ASCII
    docs = spark.createDataFrame(rows, "id string, title string")
    ranks = spark.createDataFrame([(i, rnd.choice([0.1, 0.2, rnd.random() * 5])) for i in sorted({r[0] for r in rows})], "id string, rank double")
    asked = [(r[0], " ".join(r[1].split()[:5])) for r in rows[::9]] + [("none", "nowhere"), rows[18][:1] + ("word0 word1",), ("3x", "word0 word0 word2")]
    index = features.build_bm25(docs, ranks)
    queries = spark.createDataFrame(asked, "query_id string, query string").cache()
    terms = features.query_terms(queries)
    joined = index.postings.join(terms, "term").groupBy("query_id", "id")
    scored = joined.agg(F.expr("sum(qtf * w) as lex"), F.max("pr").alias("pr")).cache()
    return queries, index, scored


def rows(df, places=9):
    return sorted(tuple("" if v is None else round(v, places) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_frame_and_match_any(corpus):
    queries, index, scored = corpus
    assert rows(search.bm25_scores(queries, index).select(scored.columns)) == rows(scored)
    assert rows(search.match_any(queries, index)) == rows(scored.select("query_id", "id"))


def test_no_shuffle_by_query(corpus):
    queries, index, _ = corpus
    plan = search.bm25_scores(queries, index)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", plan)


@pytest.mark.parametrize("cells,docs", [(4_000_000, 1024), (100, 3), (1, 1)])
def test_results_and_sizes(corpus, monkeypatch, cells, docs):
    queries, index, scored = corpus
    monkeypatch.setattr(matches, "CELLS", cells)
    monkeypatch.setattr(matches, "DOCS", docs)
    found = matches.Matches(queries, index)
    assert found.small
    assert rows(envelope.top_for_all_alphas(found, ALPHAS, 7)) == rows(envelope.top_for_all_alphas(scored, ALPHAS, 7))
    assert rows(envelope.differences_for_all_alphas(found, queries, ALPHAS, 7)) == rows(envelope.differences_for_all_alphas(scored, queries, ALPHAS, 7))
    assert rows(evaluate.required_size(found, queries, ALPHAS)) == rows(evaluate.required_size(scored, queries, ALPHAS))


def test_lines_leave_a_task_cut(corpus):
    queries, index, scored = corpus
    left = envelope.survivors(matches.Matches(queries, index), [0.5], 2)
    tasks = queries.sparkSession.conf.get("spark.sql.shuffle.partitions")
    assert left.count() <= 2 * int(tasks) * queries.select("query_id").distinct().count() < scored.count()


def test_many_words_go_the_plain_way(corpus, monkeypatch):
    queries, index, scored = corpus
    for module in (matches, search):
        monkeypatch.setattr(module, "SMALL_ROWS", 3)
    found = matches.Matches(queries, index)
    assert not found.small and rows(found.frame().select(scored.columns)) == rows(scored)
    assert rows(evaluate.required_size(found, queries, [0.5])) == rows(evaluate.required_size(scored, queries, [0.5]))


def test_no_queries_or_no_matches(spark, corpus):
    _, index, _ = corpus
    for some in ([], [("a", "nowhere")]):
        queries = spark.createDataFrame(some, "query_id string, query string")
        found = matches.Matches(queries, index)
        assert envelope.top_for_all_alphas(found, ALPHAS, 3).collect() == []
        assert rows(evaluate.required_size(found, queries, [0.5])) == [(q, 0.5, "") for q, _ in some]
        assert envelope.differences_for_all_alphas(found, queries, ALPHAS, 3).count() == 10 * len(some)
