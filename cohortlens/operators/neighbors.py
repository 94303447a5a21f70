"""Nearest-neighbour graph and edge weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import lookup
from cohortlens.operators import blocks
from cohortlens.operators.refine import refined_knn
from cohortlens.session import materialize

# Most cells the space is cut into; bounds every table held on the driver (pivots and
# the k + 1 nearest candidates of each). Pivots are points, so crowded regions get more.
MAX_PIVOTS = 2048
# Points whose true neighbours are found by brute force, to choose how many cells ``probe`` looks into.
SAMPLE = 256
_bundles = blocks.bundles


def knn_graph(
    df: DataFrame, k: int = 15, method: str = "exact", vector: str = "vec", key: str = "id", probe: int = 4, block: int | None = None,
    pivots: int | None = None, recall: float = 0.9,
) -> DataFrame:
    """``(src, dst, dist, rank)``: the ``k`` nearest other points of every point, ties by lower key.

    Points are assigned to the nearest of a few pivots. The triangle inequality
    then bounds how far the k-th neighbour of a cell's points can be, and which
    points can be that near, so far cells are skipped without losing a
    neighbour. ``probe`` sends a candidate only to its ``probe`` nearest cells and is
    approximate. It takes as many more cells as bring the share of true neighbours
    found to ``recall``, as measured by brute force on up to ``SAMPLE`` points and less
    two standard errors, and fills cells that were sent too few candidates from the cells
    around, so that a point lacks neighbours only where there are not ``k`` others. ``refine`` is approximate too, for many
    points in many dimensions: it improves lists round by round until they hardly change and ``recall`` is reached, with work that
    is bounded per point (:mod:`cohortlens.operators.refine`). The first two work block against block: a crowded cell is cut into blocks and no pair becomes
    a row. Cells near each other share a block, and a candidate is sent to a block once, so that larger blocks send less. ``block`` is the most points of a
    block, if not those that keep what is sent small; ``pivots`` is the number of cells, at most ``MAX_PIVOTS``; a quarter of the
    root of the number of points if not given.

    Of identical points only the ``k + 1`` with the lowest keys can be anyone's
    neighbour, so copies beyond that are not candidates; they still get their own
    neighbours.
    """
    if method not in ("exact", "probe", "refine"):
        raise ValueError(f"unknown method {method!r}")
    points = df.select(F.col(key).alias("id"), F.col(vector).alias("vec"))
    if method == "refine":
        return refined_knn(points, k, recall)
    # Any points may serve as pivots; a fixed pseudo-random choice keeps runs alike.
    total = points.count()
    wanted = max(1, min(MAX_PIVOTS, pivots or math.isqrt(total) // 4))
    pivots = np.array([r["vec"] for r in points.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()])
    pivots = np.unique(pivots, axis=0)
    placed = materialize(blocks.with_nearest(points, pivots, "vec", "cell", "gap"), "cells")

    # By a hash first, as numbers are sorted faster than vectors.
    copies = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("id")
    candidates = materialize(placed.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    # Cells in order along a path from each to the nearest one left, as many to a bundle as make a block.
    size = block or blocks.own_block(total)
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    bundle = _bundles(pivots, counts, size)
    reach, filled = None, None
    if method == "exact":
        reach = _reach(placed, candidates, pivots, k)
    else:
        probe = _probe(placed, candidates, pivots, k, probe, recall)
        homes = {r["cell"]: r["count"] for r in candidates.groupBy("cell").count().collect()}
        filled = _filled(homes, pivots, k)
    routed = _route(candidates, pivots, reach, probe, filled, bundle)

    # Per bundle: blocks of its own points, and blocks of the candidates sent to it. One row per bundle.
    mine = np.zeros(bundle.max(initial=0) + 1, dtype=int)
    for cell, n in counts.items():
        mine[bundle[cell]] += n
    own = [blocks.block_count(int(n), 2 * size) for n in mine]
    # Which bundles a candidate goes to is found twice, the first time only to count them, which is cheaper than to keep it with its vector.
    sent = {r["target"]: blocks.block_count(r["n"], block or blocks.OTHERS) for r in _sent(candidates, pivots, reach, probe, filled, bundle).collect()}
    group = lookup([int(x) for x in bundle], F.col("cell"))
    own_blocks = lookup(own, F.col("cell"))
    sent_blocks = lookup([sent.get(c, 1) for c in range(len(own))], F.col("cell"))
    rows = placed.select(group.alias("cell"), "id", "vec").withColumn("a", blocks.block_of(F.col("id"), own_blocks))
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), sent_blocks - 1)))
    others = routed.select(F.col("target").alias("cell"), "id", "vec").withColumn("b", blocks.block_of(F.col("id"), sent_blocks))
    others = others.withColumn("a", F.explode(F.sequence(F.lit(0), own_blocks - 1)))
    id_type = placed.schema["id"].dataType.simpleString()
    found = (
        rows.groupBy("cell", "a", "b")
        .cogroup(others.groupBy("cell", "a", "b"))
        .applyInArrow(_best(k), f"src {id_type}, dst {id_type}, dist double")
    )
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reach(placed: DataFrame, candidates: DataFrame, pivots: np.ndarray, k: int) -> np.ndarray:
    """Per cell, a radius around its pivot outside which no candidate can be a neighbour of its points."""
    radius = np.zeros(len(pivots))
    for row in placed.groupBy("cell").agg(F.max("gap").alias("r")).collect():
        radius[row["cell"]] = row["r"]
    # The k+1 candidates nearest to each pivot: a bounded list per cell.
    near = candidates.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("gap", "id"))).where(F.col("at") <= k + 1)
    listed = near.select("cell", "gap").collect()
    cells, gaps = np.array([r["cell"] for r in listed]), np.array([r["gap"] for r in listed])
    between = blocks.distances(pivots, pivots)
    reach = np.full(len(pivots), np.inf)
    if len(listed) > k:
        for c in range(len(pivots)):
            # From any point of the cell: to its pivot, on to the candidate's pivot, on to the candidate.
            bound = np.partition(radius[c] + between[c, cells] + gaps, k)[k]
            reach[c] = bound + radius[c]
    return reach * (1 + 1e-9) + 1e-12


def _probe(placed: DataFrame, candidates: DataFrame, pivots: np.ndarray, k: int, least: int, recall: float) -> int:
    """Cells a candidate must be sent to, ``least`` at the fewest, so that a sample of points finds enough neighbours."""
    asked = placed.orderBy(F.xxhash64("id", F.lit(1)), "id").select("id", "cell", "vec").limit(SAMPLE).toPandas()
    if not len(asked):
        return least
    names, cells, vectors = asked["id"].to_numpy(), asked["cell"].to_numpy(), blocks.matrix(asked["vec"])
    id_type = candidates.schema["id"].dataType.simpleString()

    def search(batches):
        best = None
        for pdf in batches:
            for at in range(0, len(pdf), blocks.BLOCK):
                part = pdf.iloc[at : at + blocks.BLOCK]
                theirs = blocks.matrix(part["vec"])
                places = np.argsort(np.argsort(blocks.distances(theirs, pivots), axis=1, kind="stable"), axis=1)
                gaps = blocks.distances(vectors, theirs)
                gaps[names[:, None] == part["id"].to_numpy()[None, :]] = np.inf
                near = np.argsort(gaps, axis=1, kind="stable")[:, : k + 1]
                rows = np.repeat(np.arange(len(names)), near.shape[1])
                found = pd.DataFrame({
                    "query": rows.astype("int32"), "dst": part["id"].to_numpy()[near.ravel()], "dist": gaps[rows, near.ravel()],
                    "place": places[near.ravel(), cells[rows]].astype("int32"),
                })
                best = pd.concat([best, found[np.isfinite(found["dist"])]]) if best is not None else found[np.isfinite(found["dist"])]
                best = best.sort_values(["query", "dist", "dst"]).groupby("query").head(k)
        if best is not None:
            yield best

    found = candidates.select("id", "vec").mapInPandas(search, f"query int, dst {id_type}, dist double, place int")
    order = Window.partitionBy("query").orderBy("dist", "dst")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "place").toPandas()
    for probe in range(least, len(pivots)):
        share = (true["place"] < probe).groupby(true["query"]).mean().to_numpy()
        if len(share) and share.mean() - 2 * share.std() / math.sqrt(len(share)) >= recall:
            return probe
    return max(least, len(pivots))


def _filled(homes: dict[int, int], pivots: np.ndarray, k: int) -> np.ndarray:
    """``[home, target]``: whether a cell's candidates go to a target that would else have fewer than ``k + 1``."""
    count = np.array([homes.get(c, 0) for c in range(len(pivots))])
    out = np.zeros((len(pivots), len(pivots)), dtype=bool)
    for c in np.flatnonzero(count < k + 1):
        around = np.argsort(blocks.distances(pivots[c : c + 1], pivots)[0], kind="stable")
        enough = int(np.searchsorted(np.cumsum(count[around]), k + 1)) + 1
        out[around[:enough], c] = True
    return out


def _targets(pivots: np.ndarray, reach: np.ndarray | None, probe: int, filled: np.ndarray | None, bundle: np.ndarray | None):
    """For an Arrow batch of candidates, part by part: the part, and which of its rows go to which cell, or bundle of cells."""

    def targets(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, blocks.BLOCK):
            part = batch.slice(at, blocks.BLOCK)
            gaps = blocks.distances(blocks.arrow_matrix(part.column("vec")), pivots)
            if reach is not None:
                sent = gaps <= reach[None, :]
            else:
                order = np.argsort(gaps, axis=1, kind="stable")
                sent = filled[order[:, 0]] if filled is not None else np.zeros(gaps.shape, dtype=bool)
                np.put_along_axis(sent, order[:, :probe], True, axis=1)
            rows, to = np.nonzero(sent)
            if bundle is not None:
                rows, to = np.divmod(np.unique(rows * len(pivots) + bundle[to]), len(pivots))
            yield part, rows, to

    return targets


def _route(candidates: DataFrame, pivots: np.ndarray, reach: np.ndarray | None, probe: int, filled: np.ndarray | None = None, bundle: np.ndarray | None = None) -> DataFrame:
    """Send each candidate to every cell that may need it, or once to each bundle of cells."""
    id_type = candidates.schema["id"].dataType.simpleString()
    targets = _targets(pivots, reach, probe, filled, bundle)

    def send(batches):
        for batch in batches:
            for part, rows, to in targets(batch):
                for some in range(0, len(rows), 8 * blocks.BLOCK):
                    sent = part.take(pa.array(rows[some : some + 8 * blocks.BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[some : some + 8 * blocks.BLOCK], pa.int32()), *sent.columns], names=["target", "id", "vec"])

    return candidates.select("id", "vec").mapInArrow(send, f"target int, id {id_type}, vec array<double>")


def _sent(candidates: DataFrame, pivots: np.ndarray, reach: np.ndarray | None, probe: int, filled: np.ndarray | None = None, bundle: np.ndarray | None = None) -> DataFrame:
    """``target, n``: how many candidates :func:`_route` sends there."""
    targets = _targets(pivots, reach, probe, filled, bundle)

    def count(batches):
        total = np.zeros(len(pivots), dtype=np.int64)
        for batch in batches:
            for _, _, to in targets(batch):
                total += np.bincount(to, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["target", "n"])

    return candidates.select("vec").mapInArrow(count, "target int, n bigint").groupBy("target").agg(F.sum("n").alias("n"))


def _best(k: int):
    """The k nearest candidates of each point within one pair of blocks."""

    def best(points: pa.Table, others: pa.Table) -> pa.Table:
        # Candidates are in key order, which settles ties.
        ids = others.column("id").to_pandas().sort_values()
        others, ids, names = others.take(pa.array(ids.index.to_numpy())), ids.to_numpy(), points.column("id").to_pandas().to_numpy()
        rows, near, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if len(names) and len(ids):
            rows, near, dist = blocks.nearest_others(names, blocks.arrow_matrix(points.column("vec")), ids, blocks.arrow_matrix(others.column("vec")), k)
        return pa.table({"src": points.column("id").take(pa.array(rows)), "dst": others.column("id").take(pa.array(near)), "dist": dist})

    return best


# --- edge weights --------------------------------------------------------------------

_HALVINGS = 64


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """Undirected ``(src, dst, weight)`` with ``src < dst``.

    Per point, the weight of a neighbour is ``exp(-max(0, d - rho) / sigma)``:
    ``rho`` is the smallest positive distance, and ``sigma`` makes the weights sum to
    log2 of the number of neighbours. Both directions of an edge join as ``a + b - ab``.
    """
    # A point's list holds its k neighbours, so the array is bounded by k.
    lists = graph.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    lists = lists.select(
        "src", "near", F.coalesce(F.array_min(F.transform(F.filter("near", lambda p: p["dist"] > 0), lambda p: p["dist"])), F.lit(0.0)).alias("rho")
    )
    lists = lists.withColumn("past", F.transform("near", lambda p: F.greatest(F.lit(0.0), p["dist"] - F.col("rho"))))
    lists = lists.withColumn("sigma", _sigma("past"))
    weighted = lists.select("src", F.explode(F.arrays_zip("near", "past")).alias("e"), "sigma").select(
        "src", F.col("e.near.dst").alias("dst"),
        F.when(F.col("e.past") <= 0, 1.0).otherwise(F.exp(-F.col("e.past") / F.col("sigma"))).alias("w"),
    )
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    both = weighted.groupBy(low.alias("src"), high.alias("dst")).agg(
        F.sum("w").alias("s"), F.when(F.count("*") == 2, F.product("w")).otherwise(0.0).alias("p")
    )
    return both.select("src", "dst", (F.col("s") - F.col("p")).alias("weight"))


@F.arrow_udf(T.DoubleType())
def _sigma(past: pa.Array) -> pa.Array:
    """Solve for sigma by halving, all points of a batch at once."""
    sizes = past.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    table = np.full((len(past), sizes.max(initial=1)), np.inf)
    rows = np.repeat(np.arange(len(past)), sizes)
    table[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = past.flatten().to_numpy(zero_copy_only=False)
    goal = np.log2(np.maximum(sizes, 1))
    low, high, mid = np.zeros(len(past)), np.full(len(past), np.inf), np.ones(len(past))
    for _ in range(_HALVINGS):
        over = np.exp(-table / mid[:, None]).sum(axis=1) > goal
        high = np.where(over, mid, high)
        low = np.where(over, low, mid)
        mid = np.where(np.isinf(high), mid * 2, (low + high) / 2)
    return pa.array(np.maximum(mid, 1e-12))
