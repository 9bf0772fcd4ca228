"""Session helpers: a local session for tests/bench, and checkpoint-directory discovery."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "rankfuse") -> SparkSession:
    """Local session used by tests and the bench. Cluster jobs bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RANKFUSE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. Only a local
    session that has none (tests) gets a fresh local folder; elsewhere executors could not read
    it, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - conf key absent
            configured = None
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="rankfuse-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def child_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with this one's settings but for ``settings``: for work that needs
    other ones, while the caller's session (and whoever else uses it) keeps its own."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and own.conf.isModifiable(name):
            own.conf.set(name, value)
    for name, value in settings.items():
        own.conf.set(name, value)
    return own


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_path(spark: SparkSession, path: str | None) -> None:
    """Remove a folder of the shared store, if there is one."""
    if path:
        fs, where = file_system(spark, path)
        fs.delete(where, True)


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """A small file of the shared store, or None if there is none."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_file(spark: SparkSession, path: str, data: bytes, new: bool = False) -> None:
    """Write a small file whole: it appears under its name when it is complete. With ``new`` an existing
    one is an error (FileExistsError), which lets one of several writers win."""
    fs, where = file_system(spark, path)
    _, part = file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    if new and fs.exists(where):
        raise FileExistsError(path)
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if not new:
        fs.delete(where, False)
    if not fs.rename(part, where):
        fs.delete(part, False)
        raise FileExistsError(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
