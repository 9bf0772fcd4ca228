"""The corpus pipeline: five stages that call the training-data operators, one after another.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
reread as the next one's ``docs``. All but the last keep the columns of ``documents``.

1. language ID: documents whose language can't be determined go;
2. exact dedup: of equal texts (white-space runs made one space) one row stays;
3. SimHash near-dedup: of each component of linked fingerprints one row stays;
4. mixing: rows are repeated or left out so that sources reach their targets, and stand in
   training order;
5. byte-level BPE: the documents as token ids, with digests of the ids and of what they decode to.

Nulls, repeated rows and empty tables: see the operators; every stage takes what the one before
it keeps, whole.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from rankfuse.llm import bpe, common, exact_dedup, language, mixing, simhash
from rankfuse.llm.queries import BPE_RANKS, SIMHASH_BITS, SIMHASH_SHINGLE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, common.table(spark, sf_dir, "pages"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs, shingle=SIMHASH_SHINGLE, bits=SIMHASH_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, vocabularies.path(BPE_RANKS), vocabularies.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: SQL can express neither the text model, nor the links' components, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, f"pipeline-{k}")
    return docs
