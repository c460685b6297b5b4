import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, key string, part int, mark boolean, length long, slice int, rank long"


def documents(spark, rows):
    """A documents table of (doc_id, text, lang) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, g, "s", 0, 1, 2, "k", 3, True, 4, 5, 6) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, null, blank, very long and equal texts, repeated rows."""
    long_text = " ".join(f"word{i % 97} other{i % 89}" for i in range(30_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en"), (2, "alpha beta gamma delta epsilon zeta", "en"), (3, "", None), (4, None, "de"), (5, " \n\t", "fr"), (6, long_text, "en"), (7, "é", "fr"), (8, "12 34", None), (1, "alpha beta gamma delta epsilon zeta", "en"), (None, "kein Schlüssel", "de"), (None, None, None), (9, "🙂 ́ ▁ <|endoftext|> don't   stop\r\n\r\n 1234", "en")]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
