"""A Bloom filter over ids, to drop rows before a shuffle that a semi-join would drop after it.

The filter is built by Spark (words of bits, grouped by their number and or-ed, partially in each
task) and has ``BITS_PER_ID`` bits for each id, ``MOST_BITS`` at most: that bounds what the driver
gathers and broadcasts (16 MB). With more ids than that allows it only lets more rows pass. It never
drops a member, so the exact join that follows gives the same rows with or without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ID = 12
MOST_BITS = 1 << 27
LEAST_BITS = 1 << 10
HASHES = 3


def _places(key: Column, bits: int) -> list[Column]:
    """``HASHES`` bit places for a 64-bit hash: its two halves, and sums of them."""
    low, high = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32)
    return [F.pmod(low + high * k, F.lit(bits)) for k in range(HASHES)]


def bloom_words(ids: DataFrame, col: str) -> np.ndarray:
    """The filter's words (unsigned, 64 bits) over the non-null values of ``col``."""
    known = ids.where(F.col(col).isNotNull()).select(F.xxhash64(col).alias("key"))
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << max(1, BITS_PER_ID * known.count() - 1).bit_length()))
    place = known.select(F.explode(F.array(*_places(F.col("key"), bits))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))  # by a column
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def maybe_members(rows: DataFrame, words: np.ndarray, *cols: str) -> DataFrame:
    """``rows`` whose ``cols`` can all be members: all that are, and a few per cent of the others."""
    sent = rows.sparkSession.sparkContext.broadcast(words)
    bits = len(words) * 64

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held = sent.value
        for places in batches:
            hit = np.ones(len(places[0]), bool)
            for p in places:
                at = p.to_numpy(zero_copy_only=False)
                hit &= (held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.array(hit)

    known = reduce(and_, [F.col(c).isNotNull() for c in cols])
    places = [p for c in cols for p in _places(F.xxhash64(c), bits)]
    return rows.where(known).where(F.arrow_udf(run, "boolean")(*places))
