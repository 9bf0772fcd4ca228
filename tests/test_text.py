import pytest
from pyspark.sql import functions as F

from rankfuse.functions import text as tx


def rows(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(tx.ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokenize_parity_mode_matches_ml_tokenizer(spark):
    from pyspark.ml.feature import Tokenizer

    vals = ["A  b C ", " x", "", "plain words", "  "]
    df = rows(spark, vals)
    ours = [r[0] for r in df.select(tx.tokenize("t", keep_empty=True)).collect()]
    ml = [r[0] for r in Tokenizer(inputCol="t", outputCol="o").transform(df).select("o").collect()]
    assert ours == ml
    assert ours[:3] == [["a", "", "b", "c"], ["", "x"], [""]]


def test_tokenize_default_drops_empties(spark):
    got = [r[0] for r in rows(spark, ["A  b C ", " x", ""]).select(tx.tokenize("t")).collect()]
    assert got == [["a", "b", "c"], ["x"], []]


def test_clean_text_glues_across_newlines(spark):
    got = rows(spark, ["Foo-Bar, baz!\nqux"]).select(tx.clean_text("t")).first()[0]
    assert got == "Foo-Bar bazqux"


def test_stop_words_only_gives_empty(spark):
    assert rows(spark, ["the of and"]).select(tx.analyze("t")).first()[0] == []


def test_remove_stopwords_keeps_duplicates_and_order(spark):
    got = rows(spark, ["b the c b"]).select(tx.remove_stopwords(tx.tokenize("t"))).first()[0]
    assert got == ["b", "c", "b"]


def test_word_or_filter(spark):
    df = rows(spark, ["alpha beta", "gamma", "Beta"])
    assert sorted(r[0] for r in tx.word_or_filter(df, "t", "beta delta").collect()) == ["alpha beta"]
    with pytest.raises(ValueError):
        tx.word_or_filter(df, "t", "   ")


def test_common_word_count_is_distinct(spark):
    df = rows(spark, ["a a b c", "x"])
    got = [r[0] for r in df.select(tx.shared_words("t", "A b z")).collect()]
    assert got == [2, 0]


def test_truncate_label(spark):
    df = rows(spark, ["short", "x" * 25])
    got = [r[0] for r in df.select(tx.truncate_label("t")).collect()]
    assert got == ["short", "x" * 20 + "..."]


def test_seeded_shuffle_is_repeatable_permutation(spark):
    df = spark.createDataFrame([("p1", ["a", "b", "c", "d", "e"])], "id string, w array<string>")
    a = df.select(tx.seeded_shuffle("w", 42, F.col("id"))).first()[0]
    b = df.select(tx.seeded_shuffle("w", 42, F.col("id"))).first()[0]
    assert a == b and sorted(a) == ["a", "b", "c", "d", "e"]


def test_the_named_characters_are_the_pattern(spark):
    every = "".join(chr(k) for k in [*range(1, 0x250), 0x3000, 0xFF21, 0x1D400])
    df = spark.createDataFrame([(every,)], "t string")
    got, want = df.select(tx.clean_text("t"), F.regexp_replace("t", tx.CLEAN_PATTERN, "")).first()
    assert got == want and len(got) == 64
    assert [r[0] for r in df.select(tx.shared_words("t", " ")).collect()] == [0]
