import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, ids string, `Position` string, kept int"
WORDS = "the and that with word stone river light quick brown fox jumps over lazy dog some other text here again".split()


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) * rnd.randrange(2) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long_text = prose(9000, 1)
    body = prose(120, 2)
    rows = [
        (1, body, "en", "b", 5, 7, "x", "y", "z", 1),
        (2, body, "en", "b", 5, 7, "x", "y", "z", 1),
        (2, body, "en", "b", 5, 7, "x", "y", "z", 1),
        (3, body.replace(" ", "\t\n ", 5), "en", "a", None, None, None, None, None, None),
        (4, None, None, None, None, None, None, None, None, None),
        (5, "", "en", "", 0, 1, "1", "1", "1", 1),
        (6, " \t\r\n\x0b\x0c ", "en", "a", 7, 1, "1", "1", "1", 1),
        (None, prose(50, 3), "fr", "c", 1, 1, "1", "1", "1", 1),
        (None, None, None, None, None, None, None, None, None, None),
        (7, long_text, "en", "hot", 1, 1, "1", "1", "1", 1),
        (8, "one", "en", "hot", 1, 1, "1", "1", "1", 1),
        (9, "é́ ÅÅ 日本語 \U0001f600 ß ΑΣ <|endoftext|> it's\xa0x\x85y\x1cz", "en", "hot", 1, 1, "1", "1", "1", 1),
        (10, prose(60, 4) + " " + body + " " + prose(70, 5), "en", "hot", 1, 1, "1", "1", "1", 1),
        (11, "Und " * 200, "de", "hot", 1, 1, "1", "1", "1", 1),
        (12, "x" * 3000, "de", "\U0001f600", 1, 1, "1", "1", "1", 1),
        (-3, prose(80, 6), "en", "￿", 1, 1, "1", "1", "1", 1),
    ]
    rows += [(100 + k, prose(30 + k, 100 + k), "en", "hot", 1, k, "1", "1", "1", 1) for k in range(30)]
    rows += [(200 + k, prose(150, 50) + f" end{k}", "en", "hot", 1, k, "1", "1", "1", 1) for k in range(20)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The edge cases as a table read from files."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
