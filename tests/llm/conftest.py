import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = ["", None, "  \n\t ", "a", "word " * 30000, "x" * 50000, "1" * 50000, "a@" * 5000, "é ß 漢 😀   ñ", "same text here twice over and over again", "same text here twice over and over again"]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge texts, a null id, a repeated row, and extra columns with names the operators use inside."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(EDGE)] + [(None, "no id here", "en", None, None), (3, "a", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as fp", "'x' as key", "2 as score", "3 as d", "'z' as ids", "7 as spans")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
