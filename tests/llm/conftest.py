import pytest

from llm.fixtures import SCHEMA, SF, TEXTS


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, very long, repeated and tied rows; other columns clash with names the operators use."""
    return spark.createDataFrame([(i, t, None, "s", "t", "u", "v", "x", "y") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
