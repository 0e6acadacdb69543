import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("n_words", T.StringType()),
                     T.StructField("kept", T.StringType()), T.StructField("key", T.StringType())])


def clash(rows):
    """(doc_id, text, lang) rows with extra columns whose names the operators use."""
    return [(*r, "extra", "extra", "extra") for r in rows]


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, a
    huge id beside a null one, clashing extra columns."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "One two three four five six seven eight nine ten eleven.", "en"), (2, None, "en"), (3, "", None),
            (4, " \t\n\r\x0b\x0c", "en"), (5, long_text, "de"), (6, long_text + " tail", None), (None, "a null id here", "en"),
            (9007199254740993, "big id, precise", "fr"), (7, "same row", "en"), (7, "same row", "en"),
            (8, "1234 !!! ###", "en"), (10, " nbsp em é漢字🎉 '" * 3, "fr"), (11, "x" * 250_000, "en")]
    return spark.createDataFrame(clash(rows), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
