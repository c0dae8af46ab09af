import pytest

from ledgerlens.llm.shipping import ship_code

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_code(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
