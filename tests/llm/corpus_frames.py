"""Small frames for the corpus operators, as fixtures to import."""

import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away into the wood again", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away into the wood again", "en", "b", 1),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (5, "word", "en", "a", 4),
    (6, "Ärger über ñandú 日本語 🙂 mixed   spaces\t\n tabs", "de", None, 40),
    (7, "x" * 400, "en", "a", 400),
    (8, " ".join(f"w{i % 977}" for i in range(6000)), "en", "a", 1),
    (9, "   ", "en", "b", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, blank and long texts, copies, a repeated row."""
    return spark.createDataFrame([*TEXTS, TEXTS[0]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
