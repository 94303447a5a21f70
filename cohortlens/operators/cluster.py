"""Clusters of points, and how well they are separated."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import lookup
from cohortlens.operators import blocks
from cohortlens.session import materialize

# Places whose surroundings are summarised for the Euclidean silhouette: the more, the closer its bounds.
CELLS = 1024


def as_vectors(df: DataFrame, key: str, columns: Sequence[str], name: str = "vec") -> DataFrame:
    """``(key, vec)`` from coordinate columns."""
    return df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias(name))


def cluster(df: DataFrame, key: str, k: int = 2, method: str = "bisecting", vector: str = "vec", seed: int = 1, micro: int = 512, most: int = 20_000) -> DataFrame:
    """``(key, cluster)`` with labels ``0..k-1``.

    ``bisecting`` splits the cluster whose split lowers the within-cluster sum of squares most.
    ``ward`` merges by the same measure, exactly, at every size: the distinct positions and
    their counts go to the driver, so more than ``most`` of them is an error.
    ``ward_centres`` is for any number of rows: Ward on ``micro`` distributed k-means centres
    weighted by their size. ``ward_summaries`` is for any number of rows too, in one pass and without a seed: Ward on ``micro``
    :func:`summaries`, whose loss is known. Which of them runs is the caller's choice alone.
    """
    if method == "ward":
        return _ward(df, key, k, vector, most)
    if method == "ward_centres":
        return _ward_centres(df, key, k, vector, seed, micro)
    if method == "ward_summaries":
        return _ward_summaries(df, key, k, vector, micro)
    if method != "bisecting":
        raise ValueError(f"unknown method {method!r}")
    ready = df.select(key, array_to_vector(vector).alias("features"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(ready)
    return model.transform(ready).select(key, "cluster")


def _ward(df: DataFrame, key: str, k: int, vector: str, most: int) -> DataFrame:
    counted = df.groupBy(vector).agg(F.count("*").alias("n"))
    distinct = counted.limit(most + 1).collect()
    if len(distinct) > most:
        raise ValueError(f"more than {most} distinct positions: use method='ward_centres' or raise `most`")
    distinct.sort(key=lambda r: list(r[vector]))
    labels = ward_labels(np.array([r[vector] for r in distinct]), np.array([r.n for r in distinct], dtype=float), k)
    # Every position has its label: a join on the position, not a search.
    table = df.sparkSession.createDataFrame([(list(r[vector]), int(c)) for r, c in zip(distinct, labels)], T.StructType([
        T.StructField("__at", df.schema[vector].dataType), T.StructField("cluster", T.IntegerType())
    ]))
    return df.select(key, vector).join(table, F.col(vector) == F.col("__at")).select(key, "cluster")


def _ward_centres(df: DataFrame, key: str, k: int, vector: str, seed: int, micro: int) -> DataFrame:
    ready = df.select(array_to_vector(vector).alias("features"))
    centres = np.array(KMeans(k=micro, seed=seed, featuresCol="features").fit(ready).clusterCenters())
    sizes = np.zeros(len(centres))
    for row in blocks.with_nearest(df.select(vector), centres, vector).groupBy("centre").count().collect():
        sizes[row["centre"]] = row["count"]
    centres, sizes = centres[sizes > 0], sizes[sizes > 0]
    order = np.lexsort(centres.T[::-1])
    centres = centres[order]
    labels = ward_labels(centres, sizes[order], k)
    placed = blocks.with_nearest(df.select(key, vector), centres, vector)
    return placed.select(key, lookup([int(x) for x in labels], F.col("centre")).alias("cluster"))


def _ward_summaries(df: DataFrame, key: str, k: int, vector: str, micro: int) -> DataFrame:
    found = sorted((r["centre"], r["n"]) for r in summaries(df, vector, micro).collect())
    if not found:
        return df.select(key, F.lit(None).cast("int").alias("cluster"))
    centres = np.array([c for c, _ in found])
    labels = ward_labels(centres, np.array([n for _, n in found], dtype=float), k)
    placed = blocks.with_nearest(df.select(key, vector), centres, vector)
    return placed.select(key, lookup([int(x) for x in labels], F.col("centre")).alias("cluster"))


# Summaries of so many tasks are merged in one.
MERGED = 16


def summaries(df: DataFrame, vector: str = "vec", limit: int = 512) -> DataFrame:
    """``(n, centre, loss)``: at most ``limit`` groups of points, their size, mean and sum of squares about it, from one pass.

    A task keeps counts, sums and sums of squares of groups (clustering features, which add up). A point joins the nearest
    group if it is no farther than the groups are wide by now, else it begins one; beyond ``2 * limit`` they are merged to ``limit`` by Ward's
    measure. The tasks' groups are merged the same way, ``MERGED`` tasks at a time, until one list is left. The total of ``loss`` is the
    within-group sum of squares that a clustering of the groups cannot see: 0 where there are at most ``limit`` different points,
    which are then groups of their own.
    """
    schema = "part int, n double, sums array<double>, squares double"
    rows = df.select(F.col(vector).alias("vec"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(limit)
        for pdf in batches:
            for at in range(0, len(pdf), blocks.BLOCK):
                x = blocks.matrix(pdf["vec"].iloc[at : at + blocks.BLOCK])
                features.add(np.ones(len(x)), x, (x**2).sum(axis=1))
        yield features.frame(0)

    parts = rows.mapInPandas(first, schema).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "summaries")

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        features = Features(limit)
        features.add(pdf["n"].to_numpy(), blocks.matrix(pdf["sums"]), pdf["squares"].to_numpy())
        return features.frame(key[0])

    while True:
        most = parts.agg(F.max("part")).first()[0]
        group = F.floor(F.col("part") / MERGED).cast("int")
        parts = materialize(parts.groupBy(group.alias("group")).applyInPandas(merged, schema), "summaries")
        if not most or most < MERGED:
            break
    square = F.aggregate("sums", F.lit(0.0), lambda t, x: t + x * x)
    return parts.select(F.col("n").cast("long").alias("n"), F.transform("sums", lambda x: x / F.col("n")).alias("centre"), F.greatest(F.lit(0.0), F.col("squares") - square / F.col("n")).alias("loss"))


class Features:
    """Counts, sums and sums of squares of at most twice ``limit`` groups of points."""

    def __init__(self, limit: int):
        self.limit, self.reach = limit, 0.0
        self.n: np.ndarray = np.zeros(0)
        self.sums: np.ndarray | None = None
        self.squares: np.ndarray = np.zeros(0)

    def add(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        for at in range(0, len(n), self.limit):
            self._add(n[at : at + self.limit], sums[at : at + self.limit], squares[at : at + self.limit])

    def _add(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        means, owner = np.unique(sums / n[:, None], axis=0, return_inverse=True)
        owner = owner.ravel()
        if self.sums is not None and len(self.sums):
            near, gap = blocks.nearest(means, self.sums / self.n[:, None])
            fresh = gap > self.reach
        else:
            self.sums, near, fresh = np.zeros((0, sums.shape[1])), np.zeros(len(means), dtype=int), np.ones(len(means), dtype=bool)
        place = np.where(fresh, len(self.n) + np.cumsum(fresh) - 1, near)[owner]
        total = len(self.n) + int(fresh.sum())
        for name, values in (("n", n), ("squares", squares)):
            setattr(self, name, np.concatenate([getattr(self, name), np.zeros(total - len(getattr(self, name)))]) + np.bincount(place, values, total))
        self.sums = np.concatenate([self.sums, np.zeros((total - len(self.sums), self.sums.shape[1]))])
        np.add.at(self.sums, place, sums)
        if total > 2 * self.limit:
            self._merge()

    def _merge(self) -> None:
        labels = ward_labels(self.sums / self.n[:, None], self.n, self.limit)
        n, squares = np.bincount(labels, self.n), np.bincount(labels, self.squares)
        sums = np.zeros((len(n), self.sums.shape[1]))
        np.add.at(sums, labels, self.sums)
        self.n, self.sums, self.squares = n, sums, squares
        # The root mean square distance of points from their mean, over all groups: wider ones are not made by joining.
        spread = np.maximum(0.0, squares - (sums**2).sum(axis=1) / n).sum() / n.sum()
        self.reach = max(self.reach, float(np.sqrt(spread)))

    def frame(self, part: int) -> pd.DataFrame:
        if len(self.n) > self.limit:
            self._merge()
        # Of a task without rows an empty column of lists, which without a type would be one of numbers.
        sums = pd.Series(list(self.sums) if self.sums is not None else [], dtype=object)
        return pd.DataFrame({"part": np.full(len(self.n), part, dtype="int32"), "n": self.n, "sums": sums, "squares": self.squares})


def ward_labels(centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Merge weighted points until ``k`` groups are left; a bounded table.

    Each merge joins the two groups whose union raises the within-group sum of squares least. A group and its
    nearest neighbour that are each other's nearest will merge at some time whatever else does, so chains of
    nearest neighbours find all merges in quadratic time and linear memory; the ``n - k`` cheapest of
    them are the first ``n - k``. Labels are numbered by the first member of each group.
    """
    n = len(centres)
    means, weight = centres.astype(float).copy(), sizes.astype(float).copy()
    alive = np.ones(n, dtype=bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        cost = ((means - means[a]) ** 2).sum(axis=1) * (weight * weight[a] / (weight + weight[a]))
        cost[~alive] = np.inf
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            chain = chain[:-2]
            total = weight[a] + weight[b]
            low, high = min(a, b), max(a, b)
            merges.append((float(cost[b]), len(merges), low, high))
            means[low] = (means[a] * weight[a] + means[b] * weight[b]) / total
            weight[low], alive[high] = total, False
        else:
            chain.append(b)
    owner = np.arange(n)
    for _, _, low, high in sorted(merges)[: max(0, n - k)]:
        a, b = owner[low], owner[high]
        owner[owner == max(a, b)] = min(a, b)
    order = {o: i for i, o in enumerate(dict.fromkeys(owner.tolist()))}
    return np.array([order[o] for o in owner.tolist()])


# --- separation ----------------------------------------------------------------------


def silhouette_points(
    df: DataFrame, cluster: str = "cluster", vector: str = "vec", metric: str = "euclidean", block: int | None = None, tolerance: float = 0.005,
    cells: int = CELLS,
) -> DataFrame:
    """``(position, cluster, n, silhouette, error)``: one row per distinct labelled position, ``n`` points on it.

    Points on one position share their silhouette, so positions are counted first and copies cost nothing. The true value is
    within ``error`` of ``silhouette``. ``sqeuclidean`` needs only sums per cluster, is linear and exact. ``euclidean`` bounds
    the sum of a position's distances to a cluster from summaries of the cluster's cells (how many points, their mean, their
    variance about it): the mean distance to a cell's points is at least the distance to their mean, and at most the root of its square plus
    the variance. That is linear for a number of ``cells``. Positions whose value is left open by more than ``tolerance``, all of
    them with a tolerance of 0, are compared with every position, block against block; each task sends on one
    partial sum per position and cluster. ``block`` is the most positions of a block, if not those that keep what is sent small.
    """
    counted = df.groupBy(F.col(cluster).alias("cluster"), F.col(vector).alias("vec")).agg(F.count("*").alias("n"))
    positions = materialize(counted.withColumn("position", F.monotonically_increasing_id()), "positions")
    exact = ["position", "cluster", "n", F.col("low").alias("silhouette"), F.lit(0.0).alias("error")]
    if metric == "sqeuclidean":
        return _scored(_squared_sums(positions)).select(*exact)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    if tolerance <= 0:
        return _scored(_distance_sums(positions, positions, block)).select(*exact)
    bounded = materialize(_scored(_bounded_sums(positions, cells, block or blocks.BLOCK)).withColumn("error", (F.col("high") - F.col("low")) / 2), "bounds")
    wide = positions.join(bounded.where(F.col("error") > tolerance).select("position"), "position", "left_semi")
    settled = bounded.where(F.col("error") <= tolerance).select("position", "cluster", "n", ((F.col("low") + F.col("high")) / 2).alias("silhouette"), "error")
    return settled.unionAll(_scored(_distance_sums(wide, positions, block)).select(*exact))


def _scored(sums: DataFrame) -> DataFrame:
    """``(position, cluster, n, low, high)``: bounds of the silhouette from ``per``, a list of ``(other, total, most, size)``.

    The silhouette falls with the mean distance to the own cluster and rises with that to the nearest other one.
    """
    own = F.get(F.filter("per", lambda p: p["other"] == F.col("cluster")), 0)
    rows = sums.select("position", "cluster", "n", own.alias("own"), *[
        F.array_min(F.transform(F.filter("per", lambda p: p["other"] != F.col("cluster")), lambda p: p[total] / p["size"])).alias(name)
        for name, total in (("b_low", "total"), ("b_high", "most"))
    ])
    alone = F.col("own.size") <= 1
    rows = rows.select("*", *[F.when(~alone, F.col(f"own.{total}") / (F.col("own.size") - 1)).alias(name) for name, total in (("a_low", "total"), ("a_high", "most"))])

    def score(a: str, b: str) -> Column:
        widest = F.greatest(a, b)
        return F.when(F.col(a).isNull() | (widest == 0), 0.0).otherwise((F.col(b) - F.col(a)) / widest)

    return rows.select("position", "cluster", "n", score("a_high", "b_low").alias("low"), score("a_low", "b_high").alias("high"))


def silhouette(
    df: DataFrame, cluster: str = "cluster", vector: str = "vec", metric: str = "euclidean", block: int | None = None, tolerance: float = 0.005,
    cells: int = CELLS,
) -> DataFrame:
    """Mean silhouette over all points, as one row ``(silhouette, error, n_points)``; the true mean is within ``error``."""
    scored = silhouette_points(df, cluster, vector, metric, block, tolerance, cells)
    mean = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("silhouette", "error")]
    return scored.agg(*mean, F.sum("n").alias("n_points"))


def _bounded_sums(positions: DataFrame, cells: int, block: int) -> DataFrame:
    """Least and greatest possible distance sums per position and cluster, blocks of positions against blocks of cells."""
    pivots = np.array([r["vec"] for r in positions.orderBy(F.xxhash64("vec"), "vec").limit(cells).select("vec").collect()])
    kind = positions.schema["cluster"].dataType.simpleString()
    added = F.col("cluster").alias("other")
    summaries = positions.select(added, "n", "vec").mapInPandas(_cell_sums(pivots), f"other {kind}, cell int, size double, sums array<double>, squares double")
    width = pivots.shape[1] if len(pivots) else 0
    total = summaries.groupBy("other", "cell").agg(F.sum("size").alias("size"), F.array(*[F.sum(F.get("sums", i)) for i in range(width)]).alias("sums"), F.sum("squares").alias("squares"))
    total = materialize(total, "cells")
    ours, theirs = blocks.block_count(positions.count(), block), blocks.block_count(total.count(), block)
    placed = positions.withColumn("a", blocks.block_of(F.col("position"), ours)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    cells_at = total.withColumn("b", F.pmod(F.xxhash64("other", "cell"), F.lit(theirs)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(ours - 1))))
    fields = [f for f in positions.schema.fields if f.name in ("position", "cluster", "n")]
    more = [T.StructField("other", positions.schema["cluster"].dataType), T.StructField("total", T.DoubleType()), T.StructField("most", T.DoubleType())]
    schema = T.StructType(sorted(fields, key=lambda f: ("position", "cluster", "n").index(f.name)) + more)

    def bounds(rows: pd.DataFrame, summed: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(summed):
            return pd.DataFrame({name: [] for name in schema.names})
        size = summed["size"].to_numpy()
        offset = blocks.matrix(summed["sums"]) / size[:, None]  # of the cell's mean from its pivot
        spread = np.maximum(summed["squares"].to_numpy() / size - (offset**2).sum(axis=1), 0.0)
        gaps = blocks.distances(blocks.matrix(rows["vec"]), pivots[summed["cell"].to_numpy()] + offset)
        least, most = gaps * size, np.sqrt(gaps * gaps + spread) * size
        parts = [
            rows[["position", "cluster", "n"]].assign(other=label, total=least[:, members].sum(axis=1), most=most[:, members].sum(axis=1))
            for label, members in summed.groupby("other").indices.items()
        ]
        return pd.concat(parts)

    partial = placed.groupBy("a", "b").cogroup(cells_at.groupBy("a", "b")).applyInPandas(bounds, schema)
    return _per_position(partial, positions)


def _cell_sums(pivots: np.ndarray):
    """Count, sums and sums of squares of the offsets from the nearest pivot, per cluster and pivot, of each batch."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), blocks.BLOCK):
                part = pdf.iloc[at : at + blocks.BLOCK]
                x, n = blocks.matrix(part["vec"]), part["n"].to_numpy().astype(float)
                cell, gap = blocks.nearest(x, pivots)
                offset = (x - pivots[cell]) * n[:, None]
                groups = part.assign(cell=cell).groupby(["other", "cell"])
                found = [(*own, n[rows].sum(), offset[rows].sum(axis=0), (n[rows] * gap[rows] ** 2).sum()) for own, rows in groups.indices.items()]
                yield pd.DataFrame(found, columns=["other", "cell", "size", "sums", "squares"]).astype({"cell": "int32"})

    return sums


def _per_position(partial: DataFrame, positions: DataFrame) -> DataFrame:
    """Partial sums added up, with the size of the cluster beside each; one entry per cluster, so the list is as short as the clustering is coarse."""
    totals = partial.groupBy("position", "cluster", "n", "other").agg(F.sum("total").alias("total"), F.sum("most").alias("most"))
    sizes = positions.groupBy(F.col("cluster").alias("other")).agg(F.sum("n").alias("size"))
    per = F.collect_list(F.struct("other", "total", "most", "size")).alias("per")
    return totals.join(sizes, "other").groupBy("position", "cluster", "n").agg(per)


def _squared_sums(positions: DataFrame) -> DataFrame:
    """Sum of squared distances to each cluster from its size, coordinate sums and sum of squares.

    ``size * |x|^2 - 2 x.s + q`` per row, with all points moved so that their mean is 0: far from the
    origin the terms would cancel each other's digits. A cluster's moments are one short row; every position
    meets each of them, which is what the result lists.
    """
    axes = positions.select("n", F.posexplode("vec").alias("i", "x")).groupBy("i").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"))
    means = axes.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda p: p["mean"]).alias("mean"))
    one = F.lit(0).alias("one")
    # Tables of one row, met on a constant: the mean is as long as a vector, the moments one entry per cluster.
    centred = positions.withColumn("one", F.lit(0)).join(F.broadcast(means.select("mean", one)), "one")
    centred = centred.withColumn("vec", F.zip_with("vec", "mean", lambda x, m: x - m)).drop("mean")
    moments = centred.select("cluster", "n", F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(
        F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q"), F.sum("n").alias("size")
    )
    rows = moments.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s"), F.sum("q").alias("q"), F.first("size").alias("size")
    )
    every = rows.agg(F.collect_list(F.struct(F.col("cluster").alias("other"), "s", "q", "size")).alias("clusters"))
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)

    def total(c):
        dot = F.aggregate(F.zip_with("vec", c["s"], lambda x, s: x * s), F.lit(0.0), lambda acc, x: acc + x)
        total = F.greatest(F.lit(0.0), c["size"] * F.col("norm") - 2.0 * dot + c["q"])
        return F.struct(c["other"].alias("other"), total.alias("total"), total.alias("most"), c["size"].alias("size"))

    met = centred.withColumn("norm", norm).join(F.broadcast(every.select("clusters", one)), "one")
    return met.select("position", "cluster", "n", F.transform("clusters", total).alias("per"))


def _distance_sums(asked: DataFrame, positions: DataFrame, block: int | None) -> DataFrame:
    """Distance sums of the asked positions to each cluster, block against block."""
    total = positions.count()
    ours, theirs = blocks.block_count(asked.count(), block or blocks.own_block(total)), blocks.block_count(total, block or blocks.OTHERS)
    left = asked.withColumn("a", blocks.block_of(F.col("position"), ours)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    # Both sides read one table: new names on this side keep its columns apart from the other's.
    right = positions.select(
        blocks.block_of(F.col("position"), theirs).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(ours - 1))).alias("a"),
        F.col("cluster").alias("other"), F.col("n").alias("weight"), F.col("vec").alias("place"),
    )
    kept = positions.select("position", "cluster", "n").schema.fields
    added = [T.StructField("other", positions.schema["cluster"].dataType), T.StructField("total", T.DoubleType())]
    schema = T.StructType(kept + added)
    names = schema.names

    def sums(rows: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(against):
            return pd.DataFrame({name: [] for name in names})
        groups = against.groupby("other").indices
        label = np.full(len(against), -1)
        for at, members in enumerate(groups.values()):
            label[members] = at
        named = label >= 0
        if not named.any():
            return pd.DataFrame({name: [] for name in names})
        found = blocks.sums_by_label(blocks.matrix(rows["vec"]), blocks.matrix(against["place"])[named], against["weight"].to_numpy(dtype=float)[named], label[named], len(groups))
        return pd.concat([rows[["position", "cluster", "n"]].assign(other=name, total=found[:, at]) for at, name in enumerate(groups)])

    partial = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(sums, schema)
    return _per_position(partial.withColumn("most", F.col("total")), positions)
