"""Where queries and their SQL counterparts are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans.views import Study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a :class:`Study` under ``name``, with the SQL that must give the same rows."""

    def keep(fn: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Study(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-even rounding spelled out so that Spark and SQL do the same double arithmetic."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def rounded_sql(x: str, digits: int = 6) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(({x})::DOUBLE * {scale}, 0) / {scale})"
