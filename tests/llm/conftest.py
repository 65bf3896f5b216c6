import pytest

AWKWARD = [
    (1, "alpha beta gamma delta epsilon", "en", "a", 30), (2, None, None, None, None), (None, "no id here at all", "en", "a", 17), (3, "", "fr", "b", 0), (4, "   \n\t ", "fr", "b", 6),
    (5, "alpha beta gamma delta epsilon", "en", "a", 30), (5, "alpha beta gamma delta epsilon", "en", "a", 30), (6, "mail a@b.co now " + "word " * 3000, "en", "c", 15016), (7, "日本語 ünï ß", "de", "c", 10), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, fp string, spans string, row string, shard string, part string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty, blank, long and repeated texts, and columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
