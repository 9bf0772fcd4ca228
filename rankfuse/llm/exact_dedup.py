"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of ASCII white space is one space (null is
the empty text). Rows are narrowed in three steps, each with partial aggregation:

1. rows whose normalised *length* no other row has are unique;
2. of the rest, those whose *prefix hash* no other row of that length has are unique;
3. only for the survivors is the *full* content hashed (SHA-256) and grouped.

No text is shuffled: a row travels as (length, prefix hash, digest). The survivors' keys are
broadcast to a second scan up to ``KEYS_SENT`` of them; beyond, that scan hashes every text. A
group of copies that holds a third of all rows is pre-aggregated on the map side, and the join
that brings its one result row back is a plain equi-join which Spark may split where it is
skewed. (``dedup`` takes the rows that go out of the texts by an anti-join, which shuffles the
texts unless Spark finds those rows few enough to broadcast.)

Built-in functions only. Nulls: a null text is the empty text; a null id is never the
smallest (a group of null ids only has a null ``keep_id``, and one row of it stays). Ties
(equal id and text): one row stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX_CHARS = 64
#: Surviving (length, prefix hash) keys, two numbers each, that may be broadcast.
KEYS_SENT = 1 << 18
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; the regex runs only where there is one to change."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[\\t\\n\\x0B\\f\\r]|  "), F.regexp_replace(text, SPACES, " ")).otherwise(text)


def refine(rows: DataFrame, digest_all: bool = False) -> DataFrame:
    """``row, id, keep_id, group_size, kept, sha`` of each of ``rows`` (``row, id, text``).

    With ``digest_all`` every row carries the digest of its normalised text; otherwise only the
    rows that reach the third step do (others: null).
    """
    base = rows.select("row", "id", normalised(F.col("text")).alias("norm"))
    sha = F.sha2("norm", 256)
    prefix = F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))
    narrow = base.select("row", "id", F.length("norm").alias("len"), prefix.alias("prefix"), *([sha.alias("sha")] if digest_all else []))
    narrow = common.stage(narrow, "dedup-keys")
    # copies are pre-aggregated before lengths meet: a length that many rows share has one row
    # for each of its prefixes here
    per = narrow.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n"))
    by_len = per.groupBy("len").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    again = per.join(by_len, "len", "left_semi").where(F.col("n") > 1).select("len", "prefix")
    again = common.stage(again, "dedup-again")
    if not digest_all:
        texts = base.select("row", "id", F.length("norm").alias("len"), prefix.alias("prefix"), "norm")
        if again.count() <= KEYS_SENT:
            marked = texts.join(F.broadcast(again.withColumn("again", F.lit(True))), ["len", "prefix"], "left")
            sha = F.when(F.col("again"), sha)
        else:  # to hash a text costs less than to shuffle it
            marked = texts
        narrow = common.stage(marked.select("row", "id", "len", "prefix", sha.alias("sha")), "dedup-full")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    groups = (
        narrow.where("sha IS NOT NULL").groupBy("len", "prefix", "sha")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .join(again, ["len", "prefix"], "left_semi").where("group_size > 1")
    )
    # read from a table, so that both sides of the join are plain shuffles that Spark can split
    groups = common.stage(groups, "dedup-groups")
    joined = narrow.join(groups, ["len", "prefix", "sha"], "left")
    return joined.select(
        "row", "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        "sha",
    )


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text")
    out = refine(rows, digest_all=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    row = common.fresh(docs, "row")[0]
    rows = common.located(docs, row)
    narrow = rows.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    gone = common.stage(refine(narrow).where("not kept").select(F.col("row").alias(row)), "dedup-gone")
    return rows.join(gone, row, "left_anti").drop(row)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS place
  FROM t
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
