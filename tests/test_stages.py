import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from rankfuse.operators import features as fe
from rankfuse.operators import search as se
from rankfuse.plans.pipeline import run_pipeline
from rankfuse.sources.stages import Stages, code_key, files_key

SF = "/root/testdata/sf0.001"


def test_a_stage_is_built_again_when_something_it_uses_changes(spark, tmp_path):
    data, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(data)

    def run(factor, code="c1"):
        st = Stages(spark, root, [data], code)
        a = st.table("a", lambda: spark.read.parquet(data).select((F.col("id") * factor).alias("x")), factor=factor)
        b = st.table("b", lambda: a.agg(F.sum("x").alias("s")), ["a"])
        c = st.table("c", lambda: spark.range(3))
        return b.first()["s"], c.count(), st.built

    assert run(1) == (10, 3, ["a", "b", "c"])
    assert run(1) == (10, 3, [])
    assert run(2) == (20, 3, ["a", "b"])
    assert run(2, "c2") == (20, 3, ["a", "b", "c"])
    shutil.rmtree(f"{root}/b")
    assert run(2, "c2") == (20, 3, ["b"])
    os.remove(f"{root}/a/_SUCCESS")  # unfinished
    assert run(2, "c2") == (20, 3, ["a"])
    spark.range(5, 8).write.mode("append").parquet(data)
    assert run(2, "c2") == (56, 3, ["a", "b", "c"])


def test_keys_of_files_and_code(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}").write_text("x" * (k + 1))
    one = files_key(spark, [str(tmp_path)])
    assert one == files_key(spark, [str(tmp_path)]) and one.startswith("3:")
    (tmp_path / "f0").write_text("longer")
    assert files_key(spark, [str(tmp_path)]) != one
    assert files_key(spark, []) == "" and code_key() != code_key("functions")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipeline"))
    return out, run_pipeline(spark, SF, out, alphas=[0.1, 0.9])


def test_pipeline_answers_with_the_alphas_it_is_asked_for(spark, run):
    out, first = run
    assert {r.alpha for r in first["alpha_sweep"].select("alpha").distinct().collect()} == {0.1, 0.9}
    other = run_pipeline(spark, SF, out, alphas=[0.0, 0.5, 1.0])
    assert {r.alpha for r in other["alpha_sweep"].select("alpha").distinct().collect()} == {0.0, 0.5, 1.0}
    assert sorted(r.stage for r in other["stages_built"].collect()) == ["alpha_differences", "alpha_stats", "alpha_sweep"]
    again = run_pipeline(spark, SF, out, alphas=[0.0, 0.5, 1.0])
    assert again["stages_built"].count() == 0


def test_pipeline_has_corpus_index_and_results(spark, run):
    out, res = run
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert res["corpus"].count() == n == fe.open_tfidf(spark, f"{out}/index").n_docs
    assert res["results"].select("query_id").distinct().count() == res["queries"].count() > 0
    assert se.search_topk(res["queries"], fe.open_tfidf(spark, f"{out}/index"), 10, 1.0, 50.0).count() == res["results"].count()
    assert json.loads(open(f"{out}/index/manifest-bm25.json").read())["n_docs"] == n
