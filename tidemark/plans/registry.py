"""Named queries over the test tables, each with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, times: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under a name, with its oracle statement if SQL can express it.

    times: the result's dates and timestamps. Both sides give them as text to the microsecond, since open ends lie beyond
    what data frames of other libraries can hold.
    """

    def add(function: Query) -> Query:
        def told(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in times})

        _QUERIES[name] = told if times else function
        if oracle:
            parts = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in times)
            _ORACLES[name] = f"SELECT * REPLACE ({parts}) FROM ({oracle})" if times else oracle
        return function

    return add


def queries() -> dict[str, Query]:
    from tidemark.plans import temporal_queries  # noqa: F401  registers on import

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _ORACLES
