"""Minimum-cost-flow resharding: old files to new shards of equal capacity, moving the fewest bytes.

1. The sizes of the old shards are summed (one row for each; that many rows go to the driver,
   which lists as many files to read the table at all).
2. ``flow.transfers`` solves a minimum-cost flow from old sizes to new capacities: bytes that stay
   in the shard of their number cost nothing, others 1. The result is a list of blocks for each
   old shard: (new shard, bytes).
3. An old shard is a line of bytes in its stored order. Each document goes with the block that
   its middle lies in, so blocks are contiguous runs and a shard misses its capacity by half a
   document for each of its blocks at most.
4. ``rewrite`` writes only the shards that changed. ``digests`` describes the rows as they lie in the shards then.

An old shard that holds a third of all rows is summed in runs of ``RUN_ROWS`` rows
(``common.prefix_sums``): no window sees a whole shard.

Nulls: a null text has no bytes (its row has the 16 of any row) and the checksum of no bytes; a
null id is a document like any other. Equal rows are separate documents. Empty tables give
empty results. Extra columns are kept by ``rewrite``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, flow

ROW_BYTES = 16
RUN_ROWS = 4096


def capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def layout(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, read from files, with ``old`` (the file) and ``at`` (the row's place in it)."""
    return docs.select("*", F.col("_metadata.file_path").alias("old"), F.col("_metadata.row_index").alias("at"))


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (a stored table with non-null ``old, at, size``) with ``shard, slot, moved``.

    ``slot`` counts the rows of a shard from 0 without a gap, in order of old shard and place.
    """
    spark = rows.sparkSession
    old = sorted((r.old, r.bytes) for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect())
    blocks = flow.transfers([b for _, b in old], capacities(sum(b for _, b in old), shards))
    plan = []
    for k, ((name, _), parts) in enumerate(zip(old, blocks)):
        ends, done = [], 0
        for _, size in parts:
            done += size
            ends.append(done)
        plan.append((name, k, ends, [j for j, _ in parts]))
    plan = spark.createDataFrame(plan, "old string, old_index int, ends array<long>, into array<int>")
    runs = rows.withColumn("_run", (F.col("at") / RUN_ROWS).cast("long"))
    lined = common.prefix_sums(runs, ["old"], ["_run"], ["at"], "size", "_before").join(plan, "old")
    middle = F.col("_before") + F.col("size") / F.lit(2.0)
    block = F.size(F.filter("ends", lambda e: e.cast("double") <= middle))
    sharded = lined.withColumn("shard", F.element_at("into", F.least(block + 1, F.size("into"))))
    sharded = sharded.withColumn("moved", F.col("shard") != F.col("old_index")).withColumn("_one", F.lit(1))
    slots = common.prefix_sums(sharded.drop("ends", "into", "_before"), ["shard"], ["old_index", "_run"], ["at"], "_one", "slot")
    return slots.drop("_run", "_one")


def digests(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; ``docs`` is read from files.

    The shards are written, and what is told of a document is read from the shard that it lies in now."""
    path = f"{common.scratch_root(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    _, rows = reshard(docs.select("doc_id", "text"), path, shards)
    body = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def rewrite(docs: DataFrame, path: str, shards: int, text: str = "text") -> list[int]:
    """Write the shards whose rows differ from the old file of the same number, as
    ``path/shard=N``; returns their numbers. A file none of whose rows leave and that none
    enter keeps its place and is not written again."""
    return reshard(docs, path, shards, text)[0]


def reshard(docs: DataFrame, path: str, shards: int, text: str = "text") -> tuple[list[int], DataFrame]:
    """``rewrite``, and the rows of all shards with ``shard`` and ``slot``: those of written shards from ``path``, those
    of the others from the old files."""
    old, at, size = common.fresh(docs, "old", "at", "size")
    rows = docs.select("*", F.col("_metadata.file_path").alias(old), F.col("_metadata.row_index").alias(at))
    sized = rows.select(F.col(old).alias("old"), F.col(at).alias("at"), (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + ROW_BYTES).cast("long").alias("size"))
    plan = common.stage(assign(common.stage(sized, "shard-rows"), shards), "shard-plan")
    moved = plan.where("moved").select(F.explode(F.array("shard", "old_index")).alias("shard")).where(F.col("shard") < shards).distinct()
    affected = sorted(r.shard for r in moved.collect())
    runs = plan.groupBy("old", "shard").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("slot").alias("from"))
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]

    def placed(of: Column) -> DataFrame:
        """The rows of some shards: a file's block for a shard is a run of its rows, so blocks are sent and not rows."""
        r = F.broadcast(runs.where(of)).alias("r")
        within = (F.col(f"d.{old}") == F.col("r.old")) & F.col(f"d.{at}").between(F.col("r.first"), F.col("r.last"))
        slot = (F.col("r.from") + F.col(f"d.{at}") - F.col("r.first")).alias("slot")
        return rows.select(*keep, old, at).alias("d").join(r, within).select(*[F.col(f"d.`{c}`") for c in keep], F.col("r.shard").alias("shard"), slot)

    written = F.col("shard").isin(affected)
    out = placed(written)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema(out.schema).parquet(path).select(*keep, "shard", "slot")
    if set(affected) == set(range(shards)):
        return affected, back
    return affected, back.unionByName(placed(~written))
