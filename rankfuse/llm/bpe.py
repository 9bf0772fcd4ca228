"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before encoding at *safe boundaries*: a space whose left neighbour is
not white space. No alternative of a byte-level pre-split pattern such as
``public_tokenizers.PATTERN`` reaches across such a place (a space only begins a token or
lies in a run of white space, and the one look-ahead concerns such runs), so the parts'
tokens joined are the tokens of the whole text. A text without such a place stays whole.

Runs of ``BLANK_CHARS`` or more white-space characters (at which the library's regular expression
runs out of stack) are cut out before: by the pattern's own rule for them a run at the end of a text is
one piece, any other one less its last character, which belongs to what follows. The library
encodes that piece.

Both directions are narrow: no shuffle, one Arrow batch in memory at a time, and a lost
executor costs only its own tasks.

Nulls: a null text encodes like the empty text (no tokens); null ids decode to empty bytes.
Repeated rows, ties and extra columns pass through; an existing column with the result's
name is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts longer than this many characters are split at the next safe boundary, again and again.
SPLIT_CHARS = 1 << 15
#: Rows of an Arrow batch held as Python objects at a time.
SLICE_ROWS = 128
SAFE = regex.compile(r"(?<=\S) ")
#: White-space runs of this many characters are pieces of their own.
BLANK_CHARS = 1 << 15


@functools.lru_cache(maxsize=4)
def encoding(rank_lines: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, rank_lines.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """Consecutive parts of ``text`` whose tokens, joined, are its tokens."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def blanks(least: int) -> regex.Pattern:
    return regex.compile(r"\p{White_Space}{%d,}+" % least)


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= min(SPLIT_CHARS, BLANK_CHARS):
        return enc.encode_ordinary(text)
    out: list[int] = []
    start = 0
    for run in blanks(BLANK_CHARS).finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in safe_parts(text[start : run.start()]):
            out += enc.encode_ordinary(part)
        if end > run.start():
            out += enc._encode_single_piece(text[run.start() : end])
        start = end
    for part in safe_parts(text[start:]):
        out += enc.encode_ordinary(part)
    return out


def encode(df: DataFrame, text: str, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` (array<int>, never null): the tokens of the whole ``text``.

    ``rank_file`` is read on the driver and broadcast: its size is that of the vocabulary
    (under 1 MB for 50,000 ranks), whatever the data.
    """
    common.prepare(df.sparkSession)
    with open(rank_file, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        for texts in batches:
            for lo in range(0, len(texts), SLICE_ROWS):
                yield pa.array([encode_text(enc, t) for t in texts.slice(lo, SLICE_ROWS).to_pylist()], pa.list_(pa.int32()))

    tokens = run(df[f"`{text}`"]).alias(ids)
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != ids.lower()], tokens)


def decode(df: DataFrame, ids: str, rank_file: str, pattern: str, data: str = "decoded") -> DataFrame:
    """``df`` with ``data`` (binary, never null): the raw bytes that the ``ids`` stand for.

    Bytes and not text, because a slice of ids may end inside a character. An id outside the
    vocabulary is an error.
    """
    common.prepare(df.sparkSession)
    with open(rank_file, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        for lists in batches:
            for lo in range(0, len(lists), SLICE_ROWS):
                yield pa.array([enc.decode_bytes(x or []) for x in lists.slice(lo, SLICE_ROWS).to_pylist()], pa.binary())

    raw = run(df[f"`{ids}`"]).alias(data)
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != data.lower()], raw)


def round_trip(df: DataFrame, text: str, rank_file: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` as by ``encode`` and ``data``, the bytes that ``decode`` gives for them, in one
    pass: the ids don't travel to a second Python worker."""
    common.prepare(df.sparkSession)
    with open(rank_file, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("struct<ids: array<int>, data: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        for texts in batches:
            for lo in range(0, len(texts), SLICE_ROWS):
                lists = [encode_text(enc, t) for t in texts.slice(lo, SLICE_ROWS).to_pylist()]
                yield pa.StructArray.from_arrays(
                    [pa.array(lists, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in lists], pa.binary())], names=["ids", "data"])

    both = common.fresh(df, "both")[0]
    out = df.withColumn(both, run(df[f"`{text}`"]))
    keep = [out[f"`{c}`"] for c in df.columns if c.lower() not in (ids.lower(), data.lower())]
    return out.select(*keep, out[both]["ids"].alias(ids), out[both]["data"].alias(data))


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    both = round_trip(docs.select("doc_id", "text"), "text", rank_file, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
