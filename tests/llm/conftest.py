import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null in every column, empty and wordless texts, repeated rows, one doc_id with two texts, line ends, other scripts.
ODD = [
    (1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1), (2, None, "en", "a", 1), (3, "", "en", None, None),
    (None, "a line of words\nanother line of words\r\n", None, None, None), (None, None, None, None, None), (4, " \n\t ", "en", "b", 3), (5, "Ünïcode «wörds» 漢字 ½ it's\x00 ok", "de", "b", 1),
    (5, "other text under a used number", "de", "b", 1), (6, "word " * 30_000, "en", "a", 150_000), (7, "!!! ... ###", "en", "c", 11),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with extra columns, some named as operators name their own."""
    rows = [(*r, f"x{k}", k, [k], "z") for k, r in enumerate(ODD)]
    return spark.createDataFrame(rows, DOCS + ", score string, row int, units array<int>, _key string")


@pytest.fixture(scope="session")
def odd_plain(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def run(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, T._parse_datatype_string(DOCS))

    return run
