"""Named queries: the operators run over the test tables, each with the SQL that checks it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plateflow.fixtures import Fixtures, with_views
from plateflow.session import compiled

_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``name``. ``sql`` may use the views of :mod:`plateflow.fixtures`."""

    def keep(run: Callable[[Fixtures], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Callable[[Fixtures], DataFrame]):
        return lambda spark, sf_dir: run(Fixtures(compiled(spark), sf_dir))

    return {name: bind(run) for name, run in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}
