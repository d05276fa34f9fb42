"""Rows that every operator has to live with."""

import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 6), (4, LONG, "en", "b", len(LONG)),
    (5, "same text twice over and over again here", "en", "b", 40), (6, "same text twice over and over again here", "en", "b", 40),
    (6, "same text twice over and over again here", "en", "b", 40), (None, "a row without any id at all", "de", None, 27),
    (8, "Ünïcödé — ﬁ Ａ é \U0001F600 \x00 ▁▁ </s>", "xx", "ß", 30), (9, "!!! ???", None, "b", None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, blanks, a long text, repeated rows, and extra columns with names that operators use themselves."""
    more = [(*row, 1, "x", b"y", 2.0, "z") for row in AWKWARD]
    return spark.createDataFrame(
        more, COLUMNS + ", id int, part string, sketch binary, key double, pii string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
