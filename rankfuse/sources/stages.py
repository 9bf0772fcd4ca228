"""Stages of a batch job whose outputs are reused only if nothing they depend on has changed.

A stage's *key* is a digest of its name and parameters, of the code of this library, of the input
files (path, length, time of change; empty ones hold nothing and don't count) and of the keys of the stages it uses. It stands beside the
output, written last: a rerun reads what is finished under the same key and builds the rest, so it
resumes after a failure and never answers with outputs of other parameters or older inputs.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
from typing import Any, Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import stage_once


def files_key(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files under ``paths``: their names, lengths and times of change. Listed by Spark and
    summed there, so any number of files is one row for the driver; no file is opened."""
    if not paths:
        return ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    each = F.xxhash64("path", "length", "modificationTime")
    n, total, other = files.agg(F.count(F.lit(1)), F.sum(each.cast("decimal(38,0)")), F.bit_xor(each)).first()
    return f"{n}:{total}:{other}"


def code_key(*left_out: str) -> str:
    """A digest of this library's source files (optional subpackages in ``left_out`` aside)."""
    root = pathlib.Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for file in sorted(root.rglob("*.py")):
        if file.relative_to(root).parts[0] not in left_out:
            digest.update(str(file.relative_to(root)).encode() + b"\0" + file.read_bytes())
    return digest.hexdigest()


class Stages:
    """The stages of one job under the folder ``root``.

    ``inputs`` are the paths that the job reads. ``keys`` tells the key of each stage so far, ``built``
    which ones this run had to build.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: Sequence[str] = (), code: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.base = [files_key(spark, inputs), code_key("llm") if code is None else code]
        self.keys: dict[str, str] = {}
        self.built: list[str] = []

    def key(self, name: str, uses: Sequence[str] = (), **params: Any) -> str:
        """The key of a stage; ``params`` must be plain values (JSON)."""
        facts = [name, params, [self.keys[u] for u in uses], self.base]
        self.keys[name] = hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
        return self.keys[name]

    def table(self, name: str, build: Callable[[], DataFrame], uses: Sequence[str] = (), **params: Any) -> DataFrame:
        """The output of a stage, built by ``build`` unless it is there under the same key."""
        def run() -> DataFrame:
            self.built.append(name)
            return build()

        return stage_once(self.spark, f"{self.root}/{name}", run, key=self.key(name, uses, **params))
