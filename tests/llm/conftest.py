import duckdb
import pytest


@pytest.fixture(scope="session")
def docs_table(data):
    """Rows of the documents as (doc_id, text, lang, source)."""
    return duckdb.connect().execute(
        f"SELECT doc_id, text, lang, source FROM read_parquet('{data}/documents.parquet') ORDER BY 1").fetchall()


@pytest.fixture
def many_partitions(spark):
    """Small inputs stay on as many partitions as the settings say."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)
