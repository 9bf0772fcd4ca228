import tempfile

from rankfuse.operators import features as fe
from rankfuse.operators import search as se
from rankfuse.streaming import serve


def test_stream_serving_equals_batch(spark):
    papers = spark.createDataFrame([("a", "red green"), ("b", "green blue"), ("c", "blue blue red")],
                                   "id string, title string")
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "id string, rank double")
    root = tempfile.mkdtemp(prefix="rankfuse-stream-")
    idx = fe.build_bm25(papers, ranks, store=f"{root}/index")
    q1 = spark.createDataFrame([("q1", "red"), ("q2", "blue green")], "query_id string, query string")
    q2 = spark.createDataFrame([("q3", "green")], "query_id string, query string")
    q1.write.parquet(f"{root}/in/part1")
    q2.write.parquet(f"{root}/in/part2")
    stream = serve.read_query_stream(spark, f"{root}/in/*", max_files_per_trigger=1)
    run = serve.serve_queries(stream, idx, f"{root}/out", f"{root}/ckpt", alpha=0.5, n=10)
    run.awaitTermination(120)
    got = sorted((r.query_id, r.pos, r.id) for r in serve.served_results(spark, f"{root}/out").collect())
    want = sorted((r.query_id, r.pos, r.id) for r in se.bm25_hybrid_topk(q1.unionByName(q2), idx, 0.5, 10).collect())
    assert got == want
    assert serve.batch_latency(spark, f"{root}/out").count() >= 1
