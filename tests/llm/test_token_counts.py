import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rankfuse.llm import token_counts as tc

FILE = P.path("word_bpe_49k.json")
ODD = [
    "aaa aaaa aaaaa", "ΑΣ ΣΑΣ Σ", "İstanbul ıI", "<|startoftext|>hi<|endoftext|> x<|endoftext|>", "<|STARTOFTEXT|>",
    "école ́x", "a\xa0b c\x85d\x1ce", "12345 it's IT'S we'Ll 'tis", "日本語 한국어", "\U0001f600\U0001f601 !!!???", "\x00\x01",
    "ﬁ ½ ² ª", "a﻿b​c", "ǅ ǆ Ǆ", "ß ẞ", "\r\n\t x", "Å Å", "का १२३", "z" * 5000, "ſ K Å",
    "a'S b'RE", "x\xady", "\x85\x85", "×÷¹²³", "<|endoftext|><|endoftext|>", "< | > <|", "",
]


@pytest.fixture(scope="module")
def both():
    with open(FILE, encoding="utf-8") as f:
        data = f.read()
    return tc.Counter(data), Tokenizer.from_str(data)


def lengths(lib, texts):
    return [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(both):
    counter, lib = both
    assert counter.batch(ODD) == lengths(lib, ODD)


def test_random_texts(both):
    counter, lib = both
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abAB'sStT 1²é́ İΣσς\n\t <|>endoftext日!?-_‍\x85\x1c") for _ in range(rnd.randrange(40))) for _ in range(2000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x20, 0x250), rnd.randrange(1, 0xD7FF)])) for _ in range(rnd.randrange(12))) for _ in range(2000)]
    assert counter.batch(texts) == lengths(lib, texts)


def test_a_full_memo_changes_nothing(both, monkeypatch):
    counter, lib = both
    monkeypatch.setattr(tc, "MEMO_WORDS", 3)
    texts = ["one two three four", "five six", "one two"] * 2
    assert [counter.batch([t])[0] for t in texts] == lengths(lib, texts)


def test_query_rows(docs, rows, both, none):
    got = sorted(map(tuple, tc.counts(docs, FILE, 2048).collect()), key=str)
    n = lengths(both[1], [r[1] or "" for r in rows])
    want = [(r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(rows, n)]
    assert got == sorted(want, key=str)
    assert tc.counts(none, FILE, 2048).collect() == []


def test_extra_columns_stay(docs):
    out = tc.count_tokens(docs, "text", FILE, out="size")
    assert out.columns == [c for c in docs.columns if c != "size"] + ["size"]
    assert dict(out.dtypes)["size"] == "bigint"
