"""What the operators on embeddings share: which vectors take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import pick


def sound(vector: Column) -> Column:
    """Whether every component is a finite number and one of them is not 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def sound_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct ``(id, vec)`` with an id and a sound vector, in double precision."""
    rows = pick(df, id=key, vec=vector).select(F.col("id").cast("long"), F.col("vec").cast("array<double>"))
    return rows.where(F.col("id").isNotNull() & sound(F.col("vec"))).distinct()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
