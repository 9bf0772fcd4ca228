"""Query serving as a Structured Streaming job.

The original answered queries one at a time against a search service and timed each call. Here
queries arrive as files in a directory; each micro-batch is scored as one batch (postings join,
per-query top-n) and written to ``<sink>/results/batch_id=<n>`` with overwrite, so a replayed
batch after a failure rewrites the same output (idempotent). Per-batch timings go to
``<sink>/latency`` for the latency statistics.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import Bm25Index
from ..operators.search import bm25_hybrid_topk
from ..schemas import QUERY


def read_query_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(QUERY).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger).load(path)


def serve_queries(queries: DataFrame, index: Bm25Index, sink: str, checkpoint_location: str,
                  alpha: float = 0.5, n: int = 200, available_now: bool = True) -> StreamingQuery:
    """Start the serving stream; returns the running ``StreamingQuery``. ``index`` should be a stored
    one (``build_bm25(..., store=...)``): each micro-batch then reads its tables, a lazy index would
    be built again each time."""
    spark = queries.sparkSession
    out = sink.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        t0 = time.time()
        batch = batch.persist()  # read twice
        res = bm25_hybrid_topk(batch, index, alpha, n)
        res.write.mode("overwrite").parquet(f"{out}/results/batch_id={batch_id}")
        n_queries = batch.select("query_id").distinct().count()
        batch.unpersist()
        seconds = time.time() - t0
        spark.createDataFrame([(batch_id, n_queries, seconds)], "batch_id long, n_queries long, seconds double") \
            .write.mode("overwrite").parquet(f"{out}/latency/batch_id={batch_id}")

    writer = queries.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def served_results(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink.rstrip('/')}/results").select("query_id", "pos", "id", "score", "lex", "pr")


def batch_latency(spark: SparkSession, sink: str) -> DataFrame:
    """``(key, seconds)`` rows for the latency statistics: seconds per query in each batch."""
    lat = spark.read.parquet(f"{sink.rstrip('/')}/latency")
    return lat.select(F.lit("batch").alias("key"), (F.col("seconds") / F.col("n_queries")).alias("seconds"))
