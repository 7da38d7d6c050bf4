import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


LONG = prose(1, 30_000, 2000)
#: Nulls in any column, empty and very long texts, repeated rows, rows of one id, odd characters.
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, "a", None), (4, LONG, "en", "b", len(LONG)), (4, LONG, "en", "b", len(LONG)),
    (5, "one", "de", None, 3), (None, prose(2, 60), "de", None, None), (None, None, None, None, None), (6, prose(3, 200), "en", "b", 1), (6, prose(4, 90), "en", "c", 1),
    (7, prose(3, 200), "fr", "a", 1), (8, "é𝄞 日本語 ﬁ \x00 \x1c <|endoftext|> <s> ▁▁ a b c", "fr", "c", 1), (9, "x" * 5000, "es", "c", 1), (10, "a b\r\n\r\n c  d " * 40, "es", "a", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def cluttered(edge):
    """The same rows with extra columns whose names operators might use."""
    from pyspark.sql import functions as F

    for c in ("id", "row", "key", "_key", "_id", "_print", "print", "n", "size", "_size", "copies", "kept", "text_key", "bytes", "words", "node", "tie", "doc", "spans", "place"):
        edge = edge.withColumn(c, F.lit("x"))
    return edge


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path
