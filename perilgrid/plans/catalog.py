"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perilgrid.plans import oracles
from perilgrid.plans import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in q.ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
