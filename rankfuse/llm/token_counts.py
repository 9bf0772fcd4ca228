"""Token counts by rank-synchronous merging of ragged numpy arrays.

For a BPE vocabulary in a ``tokenizers`` JSON file whose model marks word ends (a suffix on
the last symbol), the number of tokens of every whole text, without materialising tokens.

Method. The distinct words of an Arrow batch are cut into pre-tokens; the pre-tokens are held
together as one ragged array (flat symbol ids and a start for each sequence). In each round
every adjacent pair's merge rank is looked up at once, each sequence's lowest rank is found
with ``minimum.reduceat``, and *all* sequences apply their own lowest-rank pair at the same
time, at every place from left to right. Sequences with no pair left drop out with their
symbols counted. The number of rounds is bounded by the longest pre-token, not by the batch.

A pre-token never spans ASCII white space, so the words between it are independent and a word
met before takes its count from a per-worker memo (a cache of bounded size: when it is full
it is emptied; counts don't depend on it).

The library's own normaliser and pre-tokeniser cut every word that holds a character from
U+0250 on; below that, the same steps (lower case, the file's pattern) run on the joined words.
Special tokens of the file are matched in the raw text, as by the library's default, and
count as one each.

Nulls: a null text counts like the empty text: 0 bytes, 0 tokens. Rows are independent:
repeated rows, ties and extra columns pass through (an existing column with a result's name is
replaced); empty tables give empty results; a very long text is one row of a batch and is
counted whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

#: Words remembered by one worker (about 100 bytes each); only the speed depends on it.
MEMO_WORDS = 400_000
#: Pre-tokens merged at a time.
BLOCK = 200_000
ASCII_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


class PairTable:
    """Merge rank and merged id of a symbol pair: open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        bits = int(np.ceil(np.log2(max(2, len(keys) * 4))))
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << bits, np.iinfo(np.int32).max, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # each round one key for each free slot takes its place
            free = self.keys[slot] == np.iinfo(np.uint64).max
            first = np.zeros(len(left), bool)
            where, at = np.unique(slot, return_index=True)
            first[at] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]], self.merged[slot[put]] = keys[left[put]], ranks[left[put]], merged[left[put]]
            left, slot = left[~put], (slot[~put] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or of an empty slot (whose rank is the largest int)."""
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != np.iinfo(np.uint64).max))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            at = self.keys[slot[open_]]
            open_ = open_[(at != keys[open_]) & (at != np.iinfo(np.uint64).max)]
        return slot


class Counter:
    """Counts tokens as the library would, for one tokenizer file."""

    def __init__(self, data: str):
        spec = json.loads(data)
        model, self.lib = spec["model"], Tokenizer.from_str(data)
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("a BPE model with word ends and whole byte coverage is needed")
        kinds = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        norms = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["Split", "ByteLevel"] or norms != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unexpected normaliser or pre-tokeniser")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = regex.compile(r"[\x21-ɏ]+")
        self.space = regex.compile(r"\s")
        specials = [x["content"] for x in spec["added_tokens"]]
        self.marks = {x[0] for x in specials}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(letters[b] + end, -1) for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.uint64)
        b = np.array([vocab[y] for _, y in pairs], np.uint64)
        self.table = PairTable((a << np.uint64(32)) | b, np.arange(len(pairs), dtype=np.int32), np.array([vocab[x + y] for x, y in pairs], np.int32))
        self.memo: dict[str, int] = {}

    def pre_tokens(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The pre-tokens of all words, one after another, and the number of each word's."""
        cuts: list[bytes] = []
        counts = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                got = [w.lower().encode()]
            elif self.plain.fullmatch(w) and not self.space.search(w):
                # one character at a time: the library has no rule for the place in a word
                got = [x.encode() for x in self.pattern.findall("".join(c.lower() for c in w))]
            else:
                text = self.lib.normalizer.normalize_str(w)
                got = [from_letters(x) for x, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]
            counts[i] = len(got)
            cuts += got
        return cuts, counts

    def merge_counts(self, cuts: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each pre-token."""
        out = np.zeros(len(cuts), np.int64)
        for lo in range(0, len(cuts), BLOCK):
            out[lo : lo + BLOCK] = self._merge_block(cuts[lo : lo + BLOCK])
        return out

    def _merge_block(self, cuts: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        done = np.ones(len(cuts), np.int64)
        done[size == 0] = 0
        flat = np.frombuffer(b"".join(cuts), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[flat]
        tail = ends[size > 0] - 1
        sym[tail] = self.last[flat[tail]]
        if (sym < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        seq = np.repeat(np.arange(len(cuts)), size)
        none = np.iinfo(np.int32).max
        keep = size[seq] > 1
        sym, seq = sym[keep], seq[keep]
        while len(sym):
            inside = seq[1:] == seq[:-1]
            slot = self.table.find((sym[:-1].astype(np.uint64) << np.uint64(32)) | sym[1:].astype(np.uint64))
            rank = np.append(np.where(inside, self.table.ranks[slot], none), none)
            first = np.flatnonzero(np.append(True, ~inside))
            best = np.minimum.reduceat(rank, first)
            owner = np.cumsum(np.append(False, ~inside))
            hit = (rank == best[owner]) & (rank < none)
            # a pair of equal symbols can overlap itself (aaa): of a run of hits take every other
            run_start = hit & ~np.append(False, hit[:-1])
            at = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(run_start, at, 0))
            hit &= (at - start) % 2 == 0
            places = np.flatnonzero(hit)
            sym[places] = self.table.merged[slot[places]]
            gone = np.zeros(len(sym), bool)
            gone[places + 1] = True
            over = best == none
            if over.any():  # nothing left to merge: count the symbols, drop the sequence
                lengths = np.diff(np.append(first, len(sym)))
                done[seq[first[over]]] = lengths[over]
                gone |= over[owner]
            sym, seq = sym[~gone], seq[~gone]
        return done

    def learn(self, words: list[str]) -> None:
        cuts, counts = self.pre_tokens(words)
        sums = np.append(0, np.cumsum(self.merge_counts(cuts)))
        ends = np.cumsum(counts)
        self.memo.update(zip(words, (sums[ends] - sums[ends - counts]).tolist(), strict=True))

    def words(self, text: str) -> list[str]:
        return [w for w in text.translate(ASCII_SPACE).split(" ") if w] if not text.isprintable() else [w for w in text.split(" ") if w]

    def batch(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            n = 0
            if any(m in t for m in self.marks):
                found = self.special.findall(t)
                n = len(found)
                if n:
                    t = self.special.sub(" ", t)
            split.append(self.words(t))
            extra.append(n)
        new = set().union(*split) - self.memo.keys()
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = set().union(*split)
        self.learn(list(new))
        get = self.memo.__getitem__
        return [n + sum(map(get, w)) for n, w in zip(extra, split, strict=True)]


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


LETTER_BYTES = {c: b for b, c in enumerate(byte_letters())}


def from_letters(text: str) -> bytes:
    return bytes(map(LETTER_BYTES.__getitem__, text))


@functools.lru_cache(maxsize=2)
def counter(data: str) -> Counter:
    return Counter(data)


def count_tokens(df: DataFrame, text: str, tokenizer_file: str, out: str = "n_tokens") -> DataFrame:
    """``df`` with ``out`` (long, never null): the tokens of the whole ``text``.

    ``tokenizer_file`` is read on the driver and broadcast; its size is the vocabulary's
    (1.7 MB for 49,000 entries), whatever the data.
    """
    common.prepare(df.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(data.value)
        for texts in batches:
            counts = []
            for lo in range(0, len(texts), 1000):
                counts += c.batch([t or "" for t in texts.slice(lo, 1000).to_pylist()])
            yield pa.array(counts, pa.int64())

    counted = run(df[f"`{text}`"]).alias(out)
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != out.lower()], counted)


def counts(docs: DataFrame, tokenizer_file: str, limit: int) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, "text", tokenizer_file)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
