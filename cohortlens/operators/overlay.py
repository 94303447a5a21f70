"""Tables behind the scatter plots: labelled points, condition markers, jitter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points(embedding: DataFrame, clusters: DataFrame, key: str, column: str = "cluster") -> DataFrame:
    """Coordinates with their cluster label, matched on the key."""
    return embedding.join(clusters.select(key, column), key)


def overlay(labelled: DataFrame, conditions: DataFrame, key: str, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Add ``marker``: the first rule whose flags are all 1, null when none is.

    One join and one pass for all clusters and all markers.
    """
    flags = sorted({f for _, names in rules for f in names})
    joined = labelled.join(conditions.select(key, *flags), key)
    marker = F.lit(None).cast("string")
    for name, names in reversed(list(rules)):
        hit = F.lit(True)
        for flag in names:
            hit = hit & (F.col(flag) == 1)
        marker = F.when(hit, name).otherwise(marker)
    return joined.withColumn("marker", marker)


def overlay_counts(marked: DataFrame, column: str = "cluster") -> DataFrame:
    return marked.groupBy(column, "marker").agg(F.count("*").alias("n"))


def jitter(df: DataFrame, columns: Sequence[str], low: float, high: float, key: str, seed: int = 0) -> DataFrame:
    """Add uniform noise in ``[low, high)`` to each column, a stream of its own per column.

    The noise comes from the MD5 of ``key:column number:seed``, so a point moves alike however the rows are dealt.
    """
    def noise(i: int):
        text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{i}:{seed}"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)

    return df.withColumns({c: F.col(c) + (F.lit(low) + F.lit(high - low) * noise(i)) for i, c in enumerate(columns)})
