"""Joins, and the cohort selection built on them.

No broadcast is forced: Catalyst broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits skewed
partitions of the shuffled joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inner(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, _names(on), "inner")


def left(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, _names(on), "left")


def right(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, _names(on), "right")


def left_semi(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, _names(on), "left_semi")


def _names(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def explode_codes(df: DataFrame, column: str) -> DataFrame:
    """One row per array element, in place; rows with a null or empty array go."""
    return df.withColumn(column, F.explode(column))


def flagged_records(
    records: DataFrame, dx_map: DataFrame, cohort: DataFrame, flag: str, code: str = "diagnosis_id", key: str = "patient_id"
) -> DataFrame:
    """Records of cohort members whose code carries the flag.

    The final flag test removes every row an outer join would add, so both
    joins are inner. Duplicates in the map or the cohort multiply rows, as they
    do in any join.
    """
    flagged = dx_map.where(F.col(flag))
    return inner(inner(records, flagged, code), cohort, key)


def flagged_ids(
    sources: Sequence[DataFrame], dx_map: DataFrame, cohort: DataFrame, flag: str, code: str = "diagnosis_id", key: str = "patient_id"
) -> DataFrame:
    """Distinct cohort members with a flagged code in any of ``sources``.

    Only ids are wanted, so semi-joins are enough. The one shuffle of a small map
    and cohort is that of the ids, made distinct on each task first. Catalyst
    moves both semi-joins below the union, so only matching rows reach it.
    """
    records = sources[0].select(key, code)
    for df in sources[1:]:
        records = records.unionByName(df.select(key, code))
    ids = left_semi(records, dx_map.where(F.col(flag)), code).select(key).distinct()
    return left_semi(ids, cohort, key)
