"""Order-based operators that stay distributed: global positions, fractions, quantiles, top-n.

``with_global_position`` is the building block: a range-partitioned sort, then each row's
position = rows in earlier partitions + its index inside its partition. Only one row per
partition (the partition sizes) ever reaches a single task, so a hot key or a large fraction
is never gathered in one place.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_key
from ..session import ensure_checkpoint_dir

#: Multiplying by this and subtracting the excess leaves the leading 53 - 20 bits of a double.
SPLITTER = float((1 << 20) + 1)


def significant(value: Column) -> Column:
    """``value`` rounded to its leading 33 bits (a relative step of about 1e-10).

    The order key for sums of doubles: noise in the last bits, which depends on the order of
    summation, makes ties instead of deciding an order, and real differences survive at any
    magnitude (ranks shrink with the corpus). Three multiplications and subtractions, the same
    in any engine with IEEE doubles.
    """
    wide = value * F.lit(SPLITTER)
    return wide - (wide - value)


_PART_SHIFT = 33  # monotonically_increasing_id = partition index << 33 | row index in partition


def with_global_position(df: DataFrame, order: Sequence[Column], pos_col: str = "pos") -> DataFrame:
    """Add a 1-based position in the total order ``order`` (which must end in a unique key).

    The sorted rows are written once with ``checkpoint`` so positions are fixed even if tasks
    are retried, then numbered without moving rows again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    mid = "__mid"
    ordered = df.orderBy(*order).withColumn(mid, F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col(mid), _PART_SHIFT)
    sizes = ordered.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a window over it is bounded by the partition count
    offsets = sizes.select(
        "__pid",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    numbered = ordered.join(F.broadcast(offsets), pid == F.col("__pid"))
    local = F.col(mid) - F.shiftleft(F.col("__pid"), _PART_SHIFT)
    return numbered.withColumn(pos_col, F.col("__off") + local + 1).drop(mid, "__pid", "__off")


def top_fraction(df: DataFrame, order: Sequence[Column], fraction: float, pos_col: str = "pos") -> DataFrame:
    """Best ``int(fraction * count)`` rows by ``order`` (exact; count and cut both distributed). Sorts all
    rows; where the first key is a number ``top_fraction_by`` need not."""
    ranked = with_global_position(df, order, pos_col)
    total = ranked.agg(F.max(pos_col)).first()[0] or 0
    return ranked.where(F.col(pos_col) <= int(fraction * total))


def top_fraction_by(df: DataFrame, key: Column, ties: Sequence[Column], fraction: float, pos_col: str = "pos") -> DataFrame:
    """Best ``int(fraction * count)`` rows by the number ``key``, highest first, then ``ties``.

    The key at the cut is selected by counting; only the rows that reach it are sorted and numbered.
    ``df`` is read several times: hand over a table where it is costly."""
    keyed = df.withColumn("__key", key.cast("double"))
    total, valued = keyed.agg(F.count(F.lit(1)), F.count("__key")).first()
    n = int(fraction * total)
    if not n:
        return df.withColumn(pos_col, F.lit(0).cast("long")).where(F.lit(False))
    known = keyed.select("__key").where(F.col("__key").isNotNull())
    place = valued - n  # from the lowest; keys that are null come last, as in a descending sort
    if place >= 0:
        wanted = df.sparkSession.createDataFrame([(place,)], "__k long")
        cut = select_ranks(known, [], "__key", wanted).first()["value"]
        keyed = keyed.where(F.col("__key") >= F.lit(cut))
    ranked = with_global_position(keyed, [F.col("__key").desc(), *ties], pos_col)
    return ranked.where(F.col(pos_col) <= n).drop("__key")


def sample_rows(df: DataFrame, n: int, seed: str | int, *key: str) -> DataFrame:
    """``n`` rows chosen repeatably at random: smallest md5(seed|key). Top-k plan, bounded by n."""
    return df.orderBy(md5_key(seed, *key), *key).limit(n)


def topn_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, pos_col: str = "pos") -> DataFrame:
    """First ``n`` rows of each group. Spark plans a partial limit before the shuffle
    (WindowGroupLimit), so a hot group reaches its final task already cut to n rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(pos_col, F.row_number().over(w)).where(F.col(pos_col) <= n)


def hot_keys(weights: DataFrame, key: str, weight: str, parts: int) -> DataFrame:
    """``(key, salts)`` of the keys that hold more than one partition's share of ``weight``.

    Fewer than ``parts`` rows whatever the data, as their weights sum to the total at most;
    ``salts`` is the number of partitions such a key is worth.
    """
    total = weights.agg(F.sum(weight)).first()[0] or 0
    share = max(1.0, total / max(1, parts))
    return weights.where(F.col(weight) > share).select(key, F.ceil(F.col(weight) / F.lit(share)).cast("int").alias("salts"))


def spread_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame | None, spread_by: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on ``key``, with hot keys dealt to several tasks.

    Rows of ``big`` with a hot key take one of its salts by the hash of ``spread_by``; rows of
    ``small`` are repeated for each salt. ``hot`` comes from ``hot_keys`` and is broadcast: its size is
    bounded by the number of partitions.
    """
    if hot is None:
        return big.join(small, key, how)
    many = F.coalesce(F.col("salts"), F.lit(1))
    salted = big.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread_by), many).cast("int")).drop("salts")
    every = F.explode(F.sequence(F.lit(0), many - 1))
    copies = small.join(F.broadcast(hot), key, "left").withColumn("__salt", every).drop("salts")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], plain: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Equi-join in which null keys of ``by`` are equal; keeps the left side's key columns."""
    on = None
    renamed = right
    for c in [*by, *plain]:
        renamed = renamed.withColumnRenamed(c, f"__r_{c}")
        match = F.col(c).eqNullSafe(F.col(f"__r_{c}")) if c in by else F.col(c) == F.col(f"__r_{c}")
        on = match if on is None else on & match
    return left.join(renamed, on, how).drop(*[f"__r_{c}" for c in [*by, *plain]])


#: Leading bits of a value that one pass of a selection looks at, then all of them.
SELECT_BITS = (11, 27)


def leading(value: Column, bits: int) -> Column:
    """``value`` rounded to its leading ``bits``: a cell number that never falls as the value grows.

    Values so large that the rounding would overflow are cells of their own."""
    wide = value * F.lit(float((1 << (53 - bits)) + 1))
    return F.when(F.abs(value) < 1e280, wide - (wide - value)).otherwise(value)


def select_ranks(vals: DataFrame, by: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """The values at given places of each group's order, found by counting instead of sorting.

    ``wanted`` has ``by``, ``__k`` (places from 0) and what else its caller wants back. Each pass counts a
    group's values by cell, partially before the shuffle, and follows the running sums to the
    cell that a place lies in; the next pass looks at the values of those cells only, with more
    bits, the last one with all. No value is sorted and nothing is written. A group has some
    thousand cells in a pass whatever its size, so a hot group is no single task's work.
    """
    if not by:  # one group: a key of its own, so that the same equi-joins serve
        vals, wanted = (d.withColumn("__all", F.pmod(F.hash(c), F.lit(1))) for d, c in ((vals, value), (wanted, "__k")))
        return select_ranks(vals, ["__all"], value, wanted).drop("__all")
    by, extra = list(by), [c for c in wanted.columns if c not in by]
    at = wanted.withColumn("__base", F.lit(0).cast("long"))
    v, cell = F.col(value), None
    for level, new in enumerate([*[leading(v, b) for b in SELECT_BITS], v]):
        rows = vals.select(*by, v.alias("__value"), new.alias("__cell"), *([leading(v, SELECT_BITS[level - 1]).alias("__outer")] if level else []))
        keys = [*by, *(["__outer"] if level else [])]
        if level:
            inside = at.select(*by, F.col("__found").alias("__outer")).distinct()
            rows = null_safe_join(rows, inside, by, ["__outer"])
        counted = rows.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        if level:
            at = at.withColumnRenamed("__found", "__outer")
        both = null_safe_join(at, counted, by, ["__outer"] if level else [])
        place = F.col("__k") - F.col("__base")
        hit = both.where((place >= F.col("__before")) & (place < F.col("__before") + F.col("__n")))
        at = hit.select(*by, *extra, (F.col("__base") + F.col("__before")).alias("__base"), F.col("__cell").alias("__found"))
    return at.select(*by, *extra, F.col("__found").alias("value"))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / R-7 rule), per group of ``by``.

    Returns ``by..., p, value``: lazily, by counting cells (``select_ranks``), without a sort.
    """
    by = list(by)
    vals = df.select(*by, F.col(value_col).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counts = vals.groupBy(*by).agg(F.count(F.lit(1)).alias("__cnt")).where(F.col("__cnt") > 0)
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    ends = F.explode(F.array(F.floor("__h").cast("long"), F.ceil("__h").cast("long")))
    wanted = counts.select(*by, "__cnt", F.explode(probs_arr).alias("p")).select(
        *by, "p", ((F.col("__cnt") - 1) * F.col("p")).alias("__h")).select(*by, "p", "__h", ends.alias("__k")).distinct()
    found = select_ranks(vals, by, "__v", wanted)
    frac = F.col("__h") - F.floor("__h")
    low, high = F.min("value"), F.max("value")
    return found.groupBy(*by, "p").agg((low + (high - low) * F.first(frac)).alias("value"))
