import pytest

WEIRD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "a"), (6, "a"), (6, "a"), (None, "null id"), (None, None),
    (7, "No matter what the the the 42 !!"), (8, "Ünïcode 日本語 русский 👩‍👩‍👧 ß ﬁ"), (9, "x" * 200_000), (10, "word " * 30_000),
    (11, "<|endoftext|> <s> </s> ▁▁ don't it's"), (12, "\x00\x01 ctrl\ttab\r\nline"),
]


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame([(i, t, "en", "src", 1, 2, 3) for i, t in WEIRD], "doc_id long, text string, lang string, source string, n_words int, node int, passes int")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(weird):
    return weird.where("false")


def make(spark, texts, **extra):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents, as (DataFrame, {doc_id: text})."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
