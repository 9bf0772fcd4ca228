"""Descriptive statistics as distributed aggregates (exact medians/quartiles via a global sort)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import exact_quantiles, null_safe_join


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row (union + aggregate, no join)."""
    cols: list[str] = []
    types: dict[str, str] = {}
    for f in frames:
        for fld in f.schema.fields:
            cols.append(fld.name)
            types[fld.name] = fld.dataType.simpleString()
    padded = [f.select(*[(F.col(c) if c in f.columns else F.lit(None).cast(types[c])).alias(c) for c in cols])
              for f in frames]
    u = padded[0]
    for f in padded[1:]:
        u = u.unionByName(f)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def stats_by_key(df: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., {v}_mean, {v}_median, {v}_std`` (sample std; NULL for a single value)."""
    by = list(by)
    base = df.groupBy(*by).agg(
        F.avg(value_col).alias(f"{value_col}_mean"), F.stddev_samp(value_col).alias(f"{value_col}_std")
    )
    med = exact_quantiles(df, value_col, [0.5], by).select(*by, F.col("value").alias(f"{value_col}_median"))
    if not by:
        return combine_rows(base, med).select(f"{value_col}_mean", f"{value_col}_median", f"{value_col}_std")
    return null_safe_join(base, med, by, how="left").select(*by, f"{value_col}_mean", f"{value_col}_median", f"{value_col}_std")


def stats_global(df: DataFrame, value_col: str) -> DataFrame:
    return stats_by_key(df, value_col, ())


def nonnull_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    return df.agg(*[F.count(F.col(c)).alias(f"{c}_count") for c in cols])


def bucket(value: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bucket 1..bins; 0 below ``lo``, bins+1 at or above ``hi``."""
    scaled = F.floor((value - F.lit(lo)) * F.lit(float(bins)) / F.lit(float(hi - lo))) + 1
    return F.when(value < lo, 0).when(value >= hi, bins + 1).otherwise(scaled).cast("long")


def value_histogram(df: DataFrame, value_col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """``(bucket, lo, hi, count)`` for non-empty buckets."""
    width = (hi - lo) / bins
    b = bucket(F.col(value_col), lo, hi, bins)
    return df.where(F.col(value_col).isNotNull()).groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count")
    ).select(
        "bucket",
        (F.lit(lo) + (F.col("bucket") - 1) * F.lit(width)).alias("bucket_lo"),
        (F.lit(lo) + F.col("bucket") * F.lit(width)).alias("bucket_hi"),
        "count",
    )


def box_stats(df: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and whiskers (extreme values within 1.5 IQR of the quartiles), per group."""
    by = list(by)
    q = exact_quantiles(df, value_col, [0.25, 0.5, 0.75], by)
    wide = q.groupBy(*by).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    v = F.col(value_col).cast("double")
    vals = df.where(F.col(value_col).isNotNull()).select(*by, v.alias("__v"))
    if not by:  # three scalars (nulls for no values): fences become literals
        q1, q3, iqr = wide.select("q1", "q3", "iqr").first()
        j = vals.select("__v", *[F.lit(x).cast("double").alias(n) for n, x in (("q1", q1), ("q3", q3), ("iqr", iqr))])
    else:
        j = null_safe_join(vals, wide, by)
    lo_fence = F.col("q1") - 1.5 * F.col("iqr")
    hi_fence = F.col("q3") + 1.5 * F.col("iqr")
    whiskers = j.groupBy(*by).agg(
        F.min(F.when(F.col("__v") >= lo_fence, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(F.col("__v") <= hi_fence, F.col("__v"))).alias("whisker_hi"),
    )
    if not by:
        return combine_rows(wide, whiskers)
    return null_safe_join(wide, whiskers, by)


def pivot_mean(df: DataFrame, row_col: str, col_col: str, value_col: str, col_values: Sequence) -> DataFrame:
    """Mean of ``value_col`` over (row, column) keys, one output column per known column value."""
    return df.groupBy(row_col).pivot(col_col, list(col_values)).agg(F.avg(value_col))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two instants (timestamps with or without time zone)."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
