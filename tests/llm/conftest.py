import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names an operator uses itself."""
    long = " ".join(f"word{k % 977} and more" for k in range(20_000))
    rows = [
        (1, "The same text, twice. It has some words.", "en", "a", 40),
        (1, "The same text, twice. It has some words.", "en", "a", 40),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, long, "en", "b", len(long)),
        (None, "A text without an id, of a few words.", "en", "a", 37),
        (5, "  \t\n ", None, None, 5),
        (6, "漢字 🎉 é\x00\x01 ñ", "fr", "b", 11),
    ]
    extra = spark.createDataFrame([(*r, "x", 1.0, b"y", 7) for r in rows], DOCS + ", ids string, score double, media binary, fp int")
    return extra


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
