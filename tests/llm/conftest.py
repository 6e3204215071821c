import duckdb
import pytest

from edge_data import SCHEMA, SF, edge_rows


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeats, clashing extra columns."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    """The small table as ``(doc_id, text)`` in id order."""
    sql = f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id"
    return duckdb.sql(sql).fetchall()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
