import hashlib

import public_tokenizers as P
import pytest

from rankfuse.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        return bpe.encoding(f.read(), P.PATTERN)


def test_digests_equal_the_library(docs, rows, enc):
    got = sorted(map(tuple, bpe.digests(docs, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_safe_parts_keep_the_tokens(rows, enc, limit):
    odd = ["a  b \n c's  \x1c d　 e", " lead", "trail ", "   ", "x" * 500, "it 's 'll\t \t y", "a \x85 b\xa0 c"]
    for text in [*odd, *(r[1] for r in rows if r[1])]:
        parts = list(bpe.safe_parts(text, limit))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_columns_pass_through_and_empty_tables(docs, none):
    out = bpe.encode(docs, "text", RANKS, P.PATTERN)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    assert bpe.digests(none, RANKS, P.PATTERN).collect() == []


def test_decode_of_a_part_of_a_character(spark, enc):
    ids = enc.encode_ordinary("日本")
    df = spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids array<int>")
    got = [bytes(r.decoded) for r in bpe.decode(df, "ids", RANKS, P.PATTERN).collect()]
    assert got == [enc.decode_bytes(ids[:1]), b"", b""]


def test_round_trip_is_encode_then_decode(docs):
    once = bpe.round_trip(docs, "text", RANKS, P.PATTERN)
    twice = bpe.decode(bpe.encode(docs, "text", RANKS, P.PATTERN), "ids", RANKS, P.PATTERN)
    assert once.columns == twice.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u3000", "\x85", " \n\t"])
def test_runs_of_a_million_blanks(enc, blank):
    run = blank * (1_000_000 // len(blank))
    for text in (run, "a" + run, run + "b", "a" + run + "b c", run + "1" + run):
        ids = bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("least", [1, 2, 5, 40])
def test_cut_blank_runs_keep_the_tokens(rows, enc, monkeypatch, least):
    monkeypatch.setattr(bpe, "BLANK_CHARS", least)
    odd = ["a" + " " * 50 + "b", "\n" * 60, " " * 45 + "'s x", "x\u3000\u3000\x85\x85 \n 1", "a\x1c\x1c\x1cb", "  lead", "trail\t\t", "1  2   3\n\n\n4", "é \xa0 \xa0日"]
    for text in [*odd, *(r[1] for r in rows if r[1])]:
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)
