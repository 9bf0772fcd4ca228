"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one white-space-delimited word: ``[^\x20\x09-\x0D]+``.
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


_SHIPPED: set[str] = set()


#: Whole texts are long rows: Arrow batches hold this much unless the session says otherwise.
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def prepare(spark: SparkSession) -> None:
    """Make a session ready for Python functions over whole texts, once for each application.

    Sends this package to the Python workers (they need not have it; the archive of some 100 kB
    travels through Spark's own file server), and lowers the size of Arrow batches, which executors
    hold outside the heap, unless it was set when the application started.
    """
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.getConf().contains(ARROW_BATCH[0]):
        spark.conf.set(*ARROW_BATCH)
    if app in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="rankfuse-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that has not set one gets a folder of its own (tests); on a cluster
    a machine-local folder would be unreadable elsewhere, so a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rankfuse-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rankfuse-llm-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: the lineage is cut there.

    A lost executor costs at most the work since the last stage. ``release`` removes all the
    tables a session has staged.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a table that ``stage`` returned and that nothing reads any more."""
    drop(df.sparkSession, df.staged_at)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def located(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``, a struct that tells its rows apart and is the same in every scan.

    It is the file (hashed) and the row's place in it, which unlike row numbers given by tasks
    doesn't depend on how a scan is cut. ``df`` is staged first unless it is a plain read.
    """
    try:
        meta = df.metadataColumn("_metadata")
        at = F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))
        return df.select(*[df[f"`{c}`"] for c in df.columns], at.alias(name))
    except AnalysisException:
        return located(stage(df, "rows"), name)


def release(spark: SparkSession) -> None:
    """Remove every table this session has staged (call when results have been written)."""
    drop(spark, scratch_root(spark))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` is called so."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that a result column would clash with (any letter case)."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: list[str], bucket: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same group that come earlier.

    The order within a group is ``bucket`` columns, then ``order`` columns, nulls first. Buckets
    must be small (the caller's choice): rows are windowed within a bucket, and only one row
    for each bucket meets in the window over a group, so a group that holds a third of all
    rows is spread over as many tasks as it has buckets. The columns must be non-null.
    """
    from pyspark.sql import Window as W

    keys = [*group, *bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*group).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*keys, F.coalesce(before, F.lit(0)).alias("_offset"))
    own = F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return (
        df.withColumn("_own", F.coalesce(own, F.lit(0)))
        .join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.col("_own"))
        .drop("_own", "_offset")
    )
