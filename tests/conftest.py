import duckdb
import pytest

from plateflow.fixtures import BASE_TABLES
from plateflow.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


@pytest.fixture
def rows(spark):
    """``rows(ddl, [tuples])`` as a DataFrame."""
    return lambda ddl, data: spark.createDataFrame(data, ddl)
