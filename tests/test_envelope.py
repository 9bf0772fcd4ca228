import random

import pytest
from pyspark.sql import functions as F

from rankfuse.functions.grids import geomspace, linspace
from rankfuse.operators import envelope as en
from rankfuse.operators import evaluate as ev


def scored_rows(seed, sizes):
    rnd = random.Random(seed)
    out = []
    for q, m in enumerate(sizes):
        for k in range(m):
            lex = rnd.choice([rnd.uniform(0, 9), 1.0, 2.0, 0.0])
            out.append((f"q{q}", f"d{k:04d}", lex, rnd.choice([rnd.uniform(0, 5), 1.0, 1e-9 * k])))
    return out


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("cut", [7, 50_000])
@pytest.mark.parametrize("alphas, n", [(linspace(0, 1, 11), 5), (geomspace(1e-6, 1, 40), 20), ([0.5], 1), ([0.0, 1.0], 1000)])
def test_equals_the_window_plan(spark, monkeypatch, cut, alphas, n):
    monkeypatch.setattr(en, "CUT_ROWS", cut)
    rows = scored_rows(n, [1, 3, 60, 300, 25]) + [("ties", f"t{k:03d}", 1.0, 1.0) for k in range(80)]
    scored = spark.createDataFrame(rows, "query_id string, id string, lex double, pr double").repartition(5)
    want = ev.alpha_sweep(scored, alphas, n, prefilter=False)
    got = en.top_for_all_alphas(scored, alphas, n)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    queries = spark.createDataFrame([(f"q{k}",) for k in range(5)] + [("ties",), ("none",)], "query_id string")
    pairs = en.differences_for_all_alphas(scored, queries, alphas, n)
    assert rows_of(pairs) == rows_of(ev.alpha_differences_join(want, queries, alphas))


def test_tasks_cut_before_the_shuffle(spark):
    scored = spark.createDataFrame(scored_rows(3, [4000]), "query_id string, id string, lex double, pr double").repartition(2)
    left = en.survivors(scored, linspace(0, 1, 11), 10)
    assert left.count() < 400
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the test's own repartition


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "query_id string, id string, lex double, pr double")
    queries = spark.createDataFrame([("a",), ("a",)], "query_id string")
    assert en.top_for_all_alphas(none, [0.1, 0.2]).collect() == []
    assert rows_of(en.differences_for_all_alphas(none, queries, [0.1, 0.2])) == [("a", 0.1, 0.2, 0.0)]
    odd = spark.createDataFrame([("a", None, 1.0, 1.0), ("a", "x", None, 1.0), ("a", "y", 2.0, 1.0)], none.schema)
    assert [r.id for r in en.top_for_all_alphas(odd, [0.5], 3).collect()] == ["y"]
