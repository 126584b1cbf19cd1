import pytest
from llm_samples import texts

DOCS = "doc_id long, text string, n_words string, score long, chunk string, part long"


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, "x", 1, "y", 2) for k, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
