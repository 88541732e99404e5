import pytest


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    words = [f"word{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(["other", *words[1:]])
    rows = [
        (1, a + "\nshared line of seven words right here", "en", "s0", 1), (2, a, "en", "s1", 2), (3, b, "de", "s1", 3), (4, None, "en", None, 4),
        (5, "", None, "s0", None), (6, "  \n\n ", "fr", "s0", 6), (7, "x" * 200_000, "fr", "s2", 7), (8, "1234 !!", "es", "s2", 8),
        (None, "a row without an id", "en", "s0", 9), (9, "twice the same", "en", "s0", 10), (9, "twice the same", "en", "s0", 10),
        (10, "shared line of seven words right here\nÉté à la plage", "fr", "s2", 11)]
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h string, size int")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
