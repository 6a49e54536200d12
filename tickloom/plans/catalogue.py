"""All queries of the engine over the test tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_bars, queries_joins, queries_models, queries_more

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for module in (queries_bars, queries_joins, queries_models, queries_more):
    QUERIES.update(module.REGISTER.queries)
    ORACLE.update(module.REGISTER.oracle)
