"""Mixing sources to target weights along a time-varying curriculum.

1. *Targets.* All sources together keep the total size. Each source gets a share by its weight,
   stops at ``limit`` times its own size, and the excess is shared again by weight: with the
   sources in order of (cap / weight), the water level is the largest of the levels at which
   the first k are full, so no iteration is needed.
2. *Repeats.* A source's documents stand in a fixed pseudo-random order (MD5 of the id). Each is
   taken ``floor(target / size)`` times; the rest of the target takes one more of the documents
   at the front of that order, cut where the nearest document ends.
3. *Positions.* Each weight class has a schedule, a piecewise linear weight over training time
   0..1. Its integral is the cumulative demand; the words a source has given before the middle
   of a copy, as a share of its target, are put through the inverse of that integral (a
   quadratic in closed form for each segment). The result is the copy's training position.
4. *Order.* Copies are range-partitioned and sorted by position.

Built-in functions only. A source that holds a third of all rows is split by leading MD5 digits
(``common.prefix_sums``); only one row for each source meets in a single task.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id
sorts like the empty string. Rows with equal ids stay separate rows: where equal ids lie at the
cut, the smaller size goes first, then the row number. A document of size 0 is never taken. Empty tables give
empty results. Extra columns are kept by ``curriculum`` and not looked at by ``plan``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Weights over training time, as (time, weight) from time 0 to time 1; their integrals are 5, 2 and 1:
#: the heaviest class is dense at first, the lightest at the end.
Schedule = Sequence[tuple[float, float]]
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
#: Rows of a source in one MD5 bucket, about.
BUCKET_ROWS = 2_000


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def inverse(schedule: Schedule, share: Column) -> Column:
    """The time at which ``share`` of the schedule's integral is reached."""
    area = share * F.lit(integral(schedule))
    done, steps = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        slope, rest = (w1 - w0) / (t1 - t0), area - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest))
        done += (t1 - t0) * (w0 + w1) / 2
        steps.append((done, F.lit(t0) + F.try_divide(F.lit(2.0) * rest, F.lit(w0) + root)))
    out = steps[-1][1]
    for end, at in reversed(steps[:-1]):
        out = F.when(area <= F.lit(end), at).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def targets(sized: DataFrame, weights: Sequence[float], limit: int) -> DataFrame:
    """One row per source: ``source, source_size, kind, target``. ``kind``: place among the weights."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    kind = (place % len(weights)).cast("int")
    per = per.withColumn("kind", kind)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * limit)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    per = per.withColumn("level", (total - full) / left)
    level = F.max("level").over(W.partitionBy())
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return per.select("source", "source_size", "kind", target.alias("target"))


def sizes(docs: DataFrame, row: Column, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row, doc_id, source, size`` of every row; the text is read here, once."""
    return docs.select(
        row.alias("row"), docs[f"`{id_col}`"].alias("doc_id"),
        docs[f"`{source}`"].alias("source"), common.n_words(docs[f"`{text}`"]).alias("size"),
    )


def plan(sized: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, limit: int = 3) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, repeats, positions`` of every row.

    ``sized`` is a stored table as ``sizes`` gives it (it is read several times).
    ``positions``: one training position for each copy, ascending.
    """
    # one row for each source, from a table whose size is known, so that Spark broadcasts it where
    # it is small and no source is a shuffle key of all its rows
    per = common.stage(targets(sized, [integral(s) for s in schedules], limit), "mix-targets")
    digits = max(1, math.ceil(math.log(max(1, sized.count() / BUCKET_ROWS), 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # prefix sums need a non-null group
    keyed = sized.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    keyed = keyed.withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    placed = common.prefix_sums(keyed, ["_none", "_source"], ["_bucket"], ["_key", "size", "row"], "size", "_before")
    per = per.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "kind", "target")
    df = placed.join(per, ["_none", "_source"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    df = df.withColumn("_whole", whole.cast("long"))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    extra = F.col("_before") + F.col("size") / F.lit(2.0) < rest
    repeats = F.when(F.col("size") > 0, F.col("_whole") + extra.cast("long")).otherwise(F.lit(0))
    df = df.withColumn("repeats", repeats.cast("int"))

    def at(copy: Column) -> Column:
        given = copy * F.col("source_size") + F.col("_before") + F.col("size") / F.lit(2.0)
        share = given / F.col("target")
        out = inverse(schedules[0], share)
        for k, s in enumerate(schedules[1:], 1):
            out = F.when(F.col("kind") == k, inverse(s, share)).otherwise(out)
        return out

    copies = F.when(F.col("repeats") > 0, F.sequence(F.lit(0), F.col("repeats") - 1)).otherwise(F.array().cast("array<int>"))
    return df.select("row", "doc_id", "source", "size", "source_size", "target", "repeats", F.transform(copies, at).alias("positions"))


def range_sorted(df: DataFrame, *keys: Column) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mix(docs: DataFrame) -> DataFrame:
    """One row per document, in training order of the first copy, never-taken documents last:
    ``doc_id, size, source_size, target, taken, first_position``."""
    planned = plan(common.stage(sizes(docs, F.monotonically_increasing_id()), "mix-sizes"))
    out = planned.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"),
        F.try_element_at("positions", F.lit(1)).alias("first_position"),
    )
    return range_sorted(out, F.col("first_position").asc_nulls_last(), F.xxhash64("doc_id").asc())


def curriculum(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The training set: the rows of ``docs`` that the mix takes, each as often as it takes it,
    with all their columns, in order of position."""
    row, at = common.fresh(docs, "row", "position")
    rows = common.located(docs, row)
    sized = sizes(rows, F.col(row), id_col, text, source)
    taken = plan(common.stage(sized, "mix-sizes")).where("repeats > 0")
    copies = taken.select(F.col("row").alias(row), F.explode("positions").alias(at))
    return range_sorted(rows.join(copies, row), F.col(at).asc(), F.xxhash64(row).asc()).drop(row, at)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM sized GROUP BY source
), weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][kind + 1] AS weight FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, kind, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), placed AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s
), chosen AS (
  SELECT p.*, t.source_size, t.kind, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CASE WHEN size > 0 THEN whole + (before + size / 2.0::DOUBLE < target - whole * source_size)::INT ELSE 0 END AS repeats,
         (before + size / 2.0::DOUBLE) / target AS share
  FROM chosen
)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken,
  CASE WHEN repeats > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE kind
    WHEN 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * (share * 5.0::DOUBLE) / (6.0::DOUBLE + sqrt(36.0::DOUBLE + (-4.0)::DOUBLE * (share * 5.0::DOUBLE)))
    WHEN 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * (share * 2.0::DOUBLE) / (2.0::DOUBLE + sqrt(4.0::DOUBLE + 0.0::DOUBLE * (share * 2.0::DOUBLE)))
    ELSE 0.0::DOUBLE + 2.0::DOUBLE * (share * 1.0::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * (share * 1.0::DOUBLE)))
  END)) END AS first_position
FROM counted
"""
