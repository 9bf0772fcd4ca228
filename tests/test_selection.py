import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfuse.functions import stats as st
from rankfuse.operators import ordering as od


def values(seed):
    rnd = random.Random(seed)
    out = [("hot", rnd.gauss(0, 1)) for _ in range(3000)] + [("same", 2.5)] * 500
    out += [("wide", rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300)) for _ in range(300)]
    out += [("near", 1 + k * 2**-52) for k in range(200)] + [("one", -7.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 5.0), ("none", None)]
    out += [("odd", x) for x in (0.0, -0.0, 1e-310, -1e-310, 1.7e308, -1.7e308)]
    return out


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]])
def test_quantiles_equal_numpy(spark, probs):
    rows = values(len(probs))
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {(r.k, r.p): r.value for r in od.exact_quantiles(df, "v", probs, ["k"]).collect()}
    groups = {k for k, v in rows if v is not None}
    assert {k for k, _ in got} == groups
    for k in groups:
        own = [v for g, v in rows if g == k and v is not None]
        for p in probs:
            h = (len(own) - 1) * p
            lo, hi = sorted(own)[math.floor(h)], sorted(own)[math.ceil(h)]
            assert got[k, p] == lo + (hi - lo) * (h - math.floor(h)), (k, p)
    all_ = {r.p: r.value for r in od.exact_quantiles(df.where("k = 'hot'"), "v", probs).collect()}
    assert all_ == {p: pytest.approx(np.quantile([v for k, v in rows if k == "hot"], p)) for p in probs}


def test_no_sort_of_values_and_nothing_is_run_or_written(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.rand(3).alias("v"))
    plan = od.exact_quantiles(df, "v", [0.5], ["k"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan and "LogicalRDD" not in plan
    assert st.stats_global(df.limit(0), "v").first()["v_median"] is None


def test_cells_never_fall(spark):
    xs = sorted(v for _, v in values(4) if v is not None)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, v double")
    for bits in od.SELECT_BITS:
        cells = [r[0] for r in df.orderBy("i").select(od.leading(F.col("v"), bits)).collect()]
        assert cells == sorted(cells)


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 1.0])
def test_top_fraction_by_number_equals_the_sort(spark, fraction):
    rnd = random.Random(2)
    rows = [(f"d{k:03d}", rnd.choice([rnd.random(), 0.5, None, 0.25])) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, rank double")
    want = od.top_fraction(df, [F.col("rank").desc(), F.col("id").asc()], fraction)
    got = od.top_fraction_by(df, F.col("rank"), [F.col("id").asc()], fraction)
    assert sorted(map(tuple, got.select("id", "pos").collect())) == sorted(map(tuple, want.select("id", "pos").collect()))
