import pytest
from pyspark.sql import functions as F

from rankfuse.operators import graph as gr
from rankfuse.operators import membership as me


@pytest.mark.parametrize("most", [1 << 10, 1 << 27])
def test_no_member_is_dropped_and_few_others_pass(spark, monkeypatch, most):
    monkeypatch.setattr(me, "MOST_BITS", most)
    ids = spark.range(2000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id")).unionByName(spark.createDataFrame([(None,)], "id string"))
    words = me.bloom_words(ids, "id")
    assert len(words) * 64 <= most
    rows = ids.unionByName(spark.range(20000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id")))
    left = me.maybe_members(rows, words, "id")
    assert left.join(ids, "id", "left_semi").count() == 2000
    assert most < 2000 or left.count() < 2000 + 20000 * 0.02


def test_edges_are_the_same_and_fewer_are_shuffled(spark):
    papers = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
    edges = spark.range(20000).select((F.col("id") % 400).cast("string").alias("src"), (F.col("id") * 37 % 9001).cast("string").alias("dst"))
    edges = edges.unionByName(edges.limit(50)).unionByName(spark.createDataFrame([(None, "1"), ("1", None)], "src string, dst string"))
    got, plain = gr.edges_in_corpus(edges, papers), gr.edges_in_corpus(edges, papers, prefilter=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert me.maybe_members(edges, me.bloom_words(papers, "id"), "src", "dst").count() < 1.3 * plain.count()
    assert gr.edges_in_corpus(edges, papers.limit(0)).collect() == []
