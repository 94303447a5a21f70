"""Feature vectors and principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, key: str, columns: Sequence[str], nulls: str = "error", name: str = "vec") -> DataFrame:
    """``(key, vec)`` from numeric columns.

    ``nulls``: ``error`` fails the job, ``zero`` fills 0, ``mean`` fills the
    column mean (one aggregate over the table), ``drop`` leaves the row out.
    """
    cells = [F.col(c).cast("double") for c in columns]
    if nulls == "zero":
        cells = [F.coalesce(c, F.lit(0.0)) for c in cells]
    elif nulls == "mean":
        means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        cells = [F.coalesce(c, F.lit(means[n] if means[n] is not None else 0.0)) for c, n in zip(cells, columns)]
    elif nulls == "drop":
        df = df.dropna(subset=list(columns))
    elif nulls == "error":
        cells = [F.coalesce(c, F.raise_error(F.lit(f"null in feature {n}")).cast("double")) for c, n in zip(cells, columns)]
    else:
        raise ValueError(f"unknown nulls {nulls!r}")
    return df.select(key, F.array(*cells).alias(name))


def pca(df: DataFrame, key: str, k: int = 3, vector: str = "vec", prefix: str = "PC_") -> DataFrame:
    """Scores on the first ``k`` principal components as ``PC_1..PC_k``.

    The fit is two passes that reduce to a features-by-features matrix; the
    scores come from centred vectors. A component's sign is free, so it is set
    to make its largest loading positive.
    """
    ready = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(vector).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(ready).transform(ready)
    model = PCA(k=k, inputCol="centred", outputCol="scores").fit(centred.select("centred"))
    loadings = model.pc.toArray()
    signs = [1.0 if column[np.argmax(np.abs(column))] >= 0 else -1.0 for column in loadings.T]
    scores = model.transform(centred).select(key, vector_to_array("scores").alias("s"))
    return scores.select(key, *[(F.get("s", i) * F.lit(sign)).alias(f"{prefix}{i + 1}") for i, sign in enumerate(signs)])
