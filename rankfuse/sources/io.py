"""Corpus I/O: JSON (one object per line or a pretty-printed array), Parquet, CSV, staging."""

from __future__ import annotations

import uuid
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PAPER, require_columns
from ..session import drop_path, ensure_checkpoint_dir, file_system, read_file, write_file
from .json_array import read_json_array


def read_corpus_json(spark: SparkSession, path: str, schema: T.StructType = PAPER, multiline: bool = False,
                     validate: bool = True) -> DataFrame:
    """Read papers with an explicit schema (no inference pass). ``multiline``: pretty-printed arrays,
    each read by as many tasks as it has byte ranges (``json_array``).

    With a schema given, a field that the file lacks reads as null, so the check is on the values:
    ValueError if there are records and a required field (one the schema calls non-null, or the
    title) is null in all of them. ``validate=False`` spares that pass.
    """
    df = read_json_array(spark, path, schema) if multiline else spark.read.schema(schema).json(path)
    if validate:
        needed = [f.name for f in schema.fields if not f.nullable or f.name == "title"]
        seen = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in needed]).first()
        missing = [c for c in needed if not seen[c]]
        if seen["__n"] and missing:
            raise ValueError(f"missing required fields: {missing}")
    return df


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines: splittable on read, unlike one big array."""
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def corpus_project(raw: DataFrame, keep_references: bool = True) -> DataFrame:
    """Shrink a raw corpus to ``id, title[, references]`` (references optional in the input)."""
    require_columns(raw, "id", "title")
    cols = [F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title")]
    if keep_references:
        refs = F.col("references") if "references" in raw.columns else F.lit(None).cast("array<string>")
        cols.append(F.transform(refs, lambda r: r.cast("string")).alias("references"))
    return raw.select(*cols)


def corpus_head(raw: DataFrame, n: int = 1000, order_col: str = "id") -> DataFrame:
    """Deterministic first ``n`` records (a sampling operator: the limit is the feature)."""
    return corpus_project(raw).orderBy(order_col).limit(n)


def write_head(raw: DataFrame, path: str, n: int = 1000) -> None:
    """The first ``n`` records with all their fields as Parquet; an error if the path exists."""
    raw.orderBy("id").limit(n).write.mode("errorifexists").parquet(path)


def _decimals_to_double(dt: T.DataType, c: Column) -> Column:
    if isinstance(dt, T.DecimalType):
        return c.cast("double")
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _decimals_to_double(dt.elementType, x))
    if isinstance(dt, T.StructType):
        cast = F.struct(*[_decimals_to_double(f.dataType, c[f.name]).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), cast)
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _, v: _decimals_to_double(dt.valueType, v))
    return c


def decimal_to_double(df: DataFrame) -> DataFrame:
    """Cast every decimal, at any nesting depth, to double (schema-driven; no row traversal)."""
    return df.select(*[_decimals_to_double(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema.fields])


#: How staged outputs are compressed: they are written once and take disk for long.
STAGED = "zstd"


def finished(spark: SparkSession, path: str, key: str | None = None) -> bool:
    """Whether a finished output is in the folder ``path``, with a ``key`` one that was written under it."""
    root = path.rstrip("/")
    fs, mark = file_system(spark, f"{root}/_SUCCESS")
    return fs.exists(mark) and (key is None or read_file(spark, f"{root}/_KEY") == key.encode())


def stage_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet", key: str | None = None) -> DataFrame:
    """Read ``path`` if a finished output is there, else build, write and read it back.

    Job commit moves files one by one and writes ``_SUCCESS`` last, so only a folder with that
    mark is finished; anything else there is a broken attempt and is overwritten. With a ``key`` (see
    ``stages.fingerprint``) an output counts only if it was written under the same one, which
    stands in the folder as ``_KEY``.
    """
    if not finished(spark, path, key):
        build().write.mode("overwrite").format(fmt).option("compression", STAGED).save(path)
        if key is not None:
            write_file(spark, f"{path.rstrip('/')}/_KEY", key.encode())
    return spark.read.format(fmt).load(path)


#: Frames of outputs in buckets that this process wrote: by application and folder, the time of ``_SUCCESS`` and the frame.
_BUCKETED: dict[tuple[str, str], tuple[int, DataFrame]] = {}


def stage_buckets(spark: SparkSession, path: str, build: Callable[[], DataFrame], schema: str, by: str, parts: int, order: Sequence[str],
                  key: str | None = None) -> DataFrame:
    """``stage_once`` of rows of this ``schema`` in ``parts`` buckets by the column ``by``, each sorted by ``order``: what is read back is still
    dealt by it, so that joins and groups by it move nothing. Read by its path, or by another process, it is a plain table.

    Spark knows buckets from its catalog only; the table stands there no longer than it takes to read its description."""
    root = path.rstrip("/")
    fs, mark = file_system(spark, f"{root}/_SUCCESS")
    place = spark.sparkContext.applicationId, root
    if not finished(spark, path, key):
        name = f"rankfuse_{uuid.uuid4().hex}"
        drop_path(spark, root)
        build().write.bucketBy(parts, by).sortBy(*order).format("parquet").option("compression", STAGED).option("path", root).saveAsTable(name)
        try:
            table = spark.table(name)
            _BUCKETED[place] = fs.getFileStatus(mark).getModificationTime(), table
        finally:
            spark.sql(f"DROP TABLE {name}")  # its files stay: it is an external one
        if key is not None:
            write_file(spark, f"{root}/_KEY", key.encode())
    written, table = _BUCKETED.get(place, (None, None))
    return table if written == fs.getFileStatus(mark).getModificationTime() else spark.read.schema(schema).parquet(root)  # no rows: no file


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder; ``release`` removes all of them."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a ``scratch`` path and read back: what follows doesn't compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(spark: SparkSession) -> None:
    """Remove everything this application has put under ``scratch`` paths."""
    drop_path(spark, _scratch_root(spark))


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankfuse-io-{spark.sparkContext.applicationId}"
