"""Nearest neighbours by refinement: lists from sorted blocks, then neighbours of neighbours, until few lists change.

The work per point is bounded: a few blocks it is compared within, and per round the pairs among one point's neighbours
and those that name it. No step compares all points with all, whatever their number or dimension. A round sends a point's
vector once to each home, a group of points near each other, in which something new is to be compared with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import lookup
from cohortlens.operators import blocks
from cohortlens.session import discard, materialize

# Points of a sorted block; orders to begin with; projections of an order and cuts of each; points the cuts are chosen on.
BLOCK, ORDERS, PROJECTIONS, CUTS, SAMPLE = 512, 3, 8, 15, 4096
# Numbers in the vectors of a home at most, its least points, most cells that homes are made of.
HOME, LEAST, CELLS = 1 << 19, 512, 1024
# Rounds at most; share of list entries that a last round changes; points whose true neighbours are looked up to measure recall.
ROUNDS, FEW, ASKED = 12, 0.005, 256
# An entry of a list: ``dst`` at home ``there`` is near ``id`` at home ``home``.
ENTRY = ("id", "home", "dst", "there", "dist", "new")


def refined_knn(points: DataFrame, k: int, recall: float = 0.9) -> DataFrame:
    """``(src, dst, dist, rank)``: nearly the ``k`` nearest other points of every point of ``(id, vec)``, nearest first, ties by lower id.

    Points are sorted along curves through a few random projections and cut into blocks of ``BLOCK``; the nearest within each block are
    the first lists. A round then compares, around every point, those in its list and up to ``k`` that list it, as far as
    one of the two is new there, and merges what is nearer into their lists. It ends when less than ``FEW`` of the entries change and the share of true
    neighbours found, measured by brute force on up to ``ASKED`` points and less two standard errors, is ``recall``; while it is less, further orders
    are added. Vectors are of one length, without nulls. Of identical points only the ``k + 1`` with the lowest ids can be
    anyone's neighbours; further copies have the ``k`` lowest of them, at distance 0, as theirs. A point lacks neighbours only
    where there are not ``k`` others.
    """
    spark = points.sparkSession
    copies = Window.partitionBy("vec").orderBy("id")
    numbered = materialize(points.select("id", "vec").withColumn("copy", F.row_number().over(copies)), "points")
    few = _at_home(numbered.where(F.col("copy") <= k + 1).select("id", "vec"))
    truth = _true_lists(few, k)
    lists, orders, fresh = None, 0, ORDERS
    while True:
        for _ in range(fresh):
            found = _in_sorted_blocks(few, k, orders)
            lists = _replace(lists, _merged(found if lists is None else found.unionAll(lists), k))
            orders += 1
        for _ in range(ROUNDS):
            known = lists.withColumn("new", F.lit(False))
            lists = _replace(lists, _merged(_compared(lists, few, k).unionAll(known), k))
            entries, changed = lists.agg(F.count("*"), F.count_if("new")).first()
            if changed <= FEW * entries:
                break
        if orders > 4 * ORDERS or _recall(lists, truth) >= recall:
            break
        fresh = ORDERS
    order = Window.partitionBy("id").orderBy("dist", "dst")
    ranked = lists.select(F.col("id").alias("src"), "dst", "dist", F.row_number().over(order).alias("rank"))
    lowest = numbered.where(F.col("copy") <= k).select("vec", F.col("id").alias("dst"), F.col("copy").alias("rank"))
    more = numbered.where(F.col("copy") > k + 1).select(F.col("id").alias("src"), "vec").join(lowest, "vec")
    return ranked.unionAll(more.select("src", "dst", F.lit(0.0).alias("dist"), "rank"))


def _at_home(points: DataFrame) -> DataFrame:
    """``(id, vec, home)``: points of neighbouring cells share a home; components as floats where that changes none of them."""
    exact, total = points.agg(F.min(F.forall("vec", lambda x: x.cast("float").cast("double").eqNullSafe(x))), F.count("*")).first()
    if exact:
        points = points.withColumn("vec", F.col("vec").cast("array<float>"))
    sample = points.orderBy(F.xxhash64("id", F.lit(-2)), "id").limit(max(1, min(CELLS, math.isqrt(total) // 2))).collect()
    if not sample:
        return points.withColumn("home", F.lit(0))
    pivots = np.unique(np.array([r["vec"] for r in sample], dtype=float), axis=0)
    size = max(LEAST, min(HOME // max(1, pivots.shape[1]), total // blocks.SIDES))
    kind = points.schema["id"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = [blocks.nearest(x[at : at + blocks.BLOCK], pivots)[0] for at in range(0, len(x), blocks.BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*cell, np.zeros(0, int)]), pa.int32())], names=["id", "vec", "cell"])

    placed = materialize(points.mapInArrow(near, f"id {kind}, vec {points.schema['vec'].dataType.simpleString()}, cell int"), "points")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    bundle = blocks.bundles(pivots, counts, size)
    held = np.bincount(bundle, [counts.get(c, 0) for c in range(len(bundle))])
    parts = np.maximum(1, -(-held // size)).astype(int)
    first = np.cumsum(parts) - parts
    begin, share = (lookup([int(v[b]) for b in bundle], F.col("cell")) for v in (first, parts))
    return placed.select("id", "vec", (begin + F.pmod(F.xxhash64("id"), share)).cast("int").alias("home"))


def _replace(old: DataFrame | None, new: DataFrame) -> DataFrame:
    stored = materialize(new, "lists")
    if old is not None:
        discard(old.sparkSession, old)
    return stored


def _merged(entries: DataFrame, k: int) -> DataFrame:
    """Lists of the ``k`` nearest, as rows ``(id, home, dst, there, dist, new)``; an entry that was known before is not new."""
    least = [F.min(c).alias(c) for c in ("home", "there", "dist", "new")]
    each = entries.repartition("id").groupBy("id", "dst").agg(*least).select(*ENTRY)
    nearest = Window.partitionBy("id").orderBy("dist", "dst")
    return each.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n")


# --- sorted blocks -------------------------------------------------------------------


def _in_sorted_blocks(points: DataFrame, k: int, number: int) -> DataFrame:
    """Entries: the nearest within blocks of points that are neighbours along the ``number``-th curve.

    A curve sorts points by the interleaved bits of ``PROJECTIONS`` random projections, each cut at the ``CUTS`` inner quantiles
    of a sample, after rotating the roles of the projections.
    """
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64("id", F.lit(number)), "id").limit(SAMPLE).select("vec").collect()])
    kind = points.schema["id"].dataType.simpleString()
    if not len(sample):
        return points.sparkSession.createDataFrame([], f"id {kind}, home int, dst {kind}, there int, dist double, new boolean")
    axes = np.random.default_rng(number).normal(size=(sample.shape[1], PROJECTIONS))
    cuts = np.quantile(sample @ axes, np.arange(1, CUTS + 1) / (CUTS + 1), axis=0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cells = np.stack([np.searchsorted(cuts[:, j], x @ axes[:, j]) for j in range(PROJECTIONS)], axis=1) if len(x) else np.zeros((0, PROJECTIONS), int)
            key = np.zeros(len(x), dtype=np.int64)
            for bit in reversed(range(4)):
                for j in range(PROJECTIONS):
                    key = key << 1 | cells[:, j] >> bit & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["id", "vec", "home", "key"])

    wide = points.schema["vec"].dataType.simpleString()
    placed = points.mapInArrow(keyed, f"id {kind}, vec {wide}, home int, key long")
    parts = max(1, math.ceil(points.count() / (16 * BLOCK)))
    dealt = placed.repartitionByRange(parts, "key", F.xxhash64("id")).sortWithinPartitions("key", F.xxhash64("id"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, homes in _blocks(batches):
            near, dist = _nearest_in_block(ids, x, k)
            yield pa.RecordBatch.from_arrays(_entries(ids, homes, np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel(), dist.ravel()), names=ENTRY[:-1])

    return dealt.select("id", "vec", "home").mapInArrow(search, f"id {kind}, home int, dst {kind}, there int, dist double").withColumn("new", F.lit(True))


def _entries(ids: pa.Array, homes: pa.Array, src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> list[pa.Array]:
    src, dst = pa.array(src), pa.array(dst)
    return [ids.take(src), homes.take(src), ids.take(dst), homes.take(dst), pa.array(dist)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """Consecutive rows in blocks of ``BLOCK``; the last one of a task takes what is left, up to half a block more."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= 3 * BLOCK // 2:
            table = pa.Table.from_batches(held).combine_chunks()
            yield _block(table.slice(0, BLOCK))
            held, rows = table.slice(BLOCK).to_batches(), rows - BLOCK
    if rows:
        yield _block(pa.Table.from_batches(held).combine_chunks())


def _block(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    ids, vectors, homes = (_whole(table, i) for i in range(3))
    return ids, _matrix(vectors), homes


def _whole(table: pa.Table, column: int | str) -> pa.Array:
    found = table.column(column).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _nearest_in_block(ids: pa.Array, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")  # so that ties go to the lower id
    gaps = blocks.distances(x, x[order])
    gaps[order, np.arange(len(order))] = np.inf
    near = np.argsort(gaps, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    return order[near], np.take_along_axis(gaps, near, axis=1)


# --- rounds --------------------------------------------------------------------------


def _compared(lists: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Entries: pairs found nearer than the farthest of their lists, around points with something new in theirs."""
    kind = points.schema["id"].dataType.simpleString()
    around, sent = _sent(lists, points, k)
    found = around.groupBy("home").cogroup(sent.groupBy("to")).applyInArrow(_pairs(k), f"id {kind}, home int, dst {kind}, there int, dist double")
    return found.withColumn("new", F.lit(True))


def _sent(lists: DataFrame, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(home, at, member, new)``, the points to be compared around each, and ``(to, name, vec, there, worst)``, what is sent to a home for it.

    The lists of a home's points meet in one task, with the vector of each point in them once, however many of them hold it.
    """
    entries = lists.select("home", F.col("id").alias("at"), F.col("dst").alias("member"), "new")
    named = lists.select(F.col("there").alias("home"), F.col("dst").alias("at"), F.col("id").alias("member"), "dist", "new")
    # The rank's limit is applied before the shuffle as well, so that a point that many name costs no more than others.
    nearest = Window.partitionBy("at").orderBy(F.desc("new"), "dist", "member")
    named = named.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).select(*entries.columns)
    dealt = entries.unionAll(named).repartition("home").withColumn("any", F.max("new").over(Window.partitionBy("home", "at")))
    around = dealt.where("any").drop("any")
    worst = lists.groupBy(F.col("id").alias("name")).agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
    known = points.select(F.col("id").alias("name"), "vec", F.col("home").alias("there")).join(worst, "name")
    sent = around.select(F.col("home").alias("to"), F.col("member").alias("name")).distinct().join(known, "name")
    return around, sent


def _pairs(k: int):
    """Pairs of a home, of each point the ``k`` nearest only, since no list takes more."""

    def pairs(around: pa.Table, sent: pa.Table) -> pa.Table:
        names = _whole(sent, "name").to_numpy(zero_copy_only=False)
        order = np.argsort(names, kind="stable")
        names, sent = names[order], sent.take(pa.array(order))
        member = _whole(around, "member").to_numpy(zero_copy_only=False)
        # A key may have several rows.
        one = np.append(True, names[1:] != names[:-1])[: len(names)]
        code, begin = np.cumsum(one) - 1, np.searchsorted(names, member)
        rows = np.searchsorted(names, member, side="right") - begin
        of = np.repeat(np.arange(len(member)), rows)
        place = np.arange(len(of)) + np.repeat(begin - (np.cumsum(rows) - rows), rows)
        at = np.unique(_whole(around, "at").to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)[of]
        new = _whole(around, "new").to_numpy(zero_copy_only=False).astype(bool)[of]
        # A member may be in a point's list and name it as well.
        order = np.lexsort((~new, place, at))
        at, place, new = at[order], place[order], new[order]
        once = np.append(True, (at[1:] != at[:-1]) | (place[1:] != place[:-1]))[: len(at)]
        at, place, new = at[once], place[once], new[once]
        x, worst = _matrix(_whole(sent, "vec")), _whole(sent, "worst").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        sizes = np.diff(np.append(starts, len(at)))
        found, held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0
        for size in np.unique(sizes[sizes > 1]):  # groups of one size side by side
            own = starts[sizes == size][:, None] + np.arange(size)
            for part in np.array_split(own, -(-len(own) * size * size * x.shape[1] // (1 << 22)) or 1):
                row, fresh = place[part], new[part]
                diff = x[row][:, :, None, :] - x[row][:, None, :, :]
                dist = np.sqrt(np.einsum("gijd,gijd->gij", diff, diff))
                worth = (fresh[:, :, None] | fresh[:, None, :]) & (dist < worst[row][:, :, None])
                worth[:, np.arange(size), np.arange(size)] = False
                g, i, j = np.nonzero(worth)
                found.append((code[row[g, i]], code[row[g, j]], dist[g, i, j]))
                held += len(g)
                if held > HOME:
                    found, held = [_nearest_each(found, k)], 0
        first = sent.filter(pa.array(one))
        return pa.Table.from_arrays(_entries(_whole(first, "name"), _whole(first, "there"), *_nearest_each(found, k)), names=ENTRY[:-1])

    return pairs


def _nearest_each(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs ``(src, dst, dist)``, each once, the ``k`` nearest of every ``src``; ties by lower ``dst``."""
    src, dst, dist = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((dist, dst, src))
    src, dst, dist = src[order], dst[order], dist[order]
    once = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))[: len(src)]
    src, dst, dist = src[once], dst[once], dist[once]
    order = np.lexsort((dst, dist, src))
    src, dst, dist = src[order], dst[order], dist[order]
    near = np.arange(len(src)) - np.searchsorted(src, src) < k
    return src[near], dst[near], dist[near]


# --- recall --------------------------------------------------------------------------


def _true_lists(points: DataFrame, k: int) -> dict:
    """The true neighbours of a few points, from every point: a bounded table per task, merged."""
    asked = points.orderBy(F.xxhash64("id", F.lit(-1)), "id").limit(ASKED).collect()
    if not asked:
        return {}
    kind = points.schema["id"].dataType.simpleString()
    names, vectors = [r["id"] for r in asked], np.array([r["vec"] for r in asked])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0)
                order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
                gaps = blocks.distances(vectors, _matrix(batch.column(1))[order])
                near = np.argsort(gaps, axis=1, kind="stable")[:, : k + 1]
                rows = np.repeat(np.arange(len(names), dtype=np.int32), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids.take(pa.array(order[near.ravel()])), pa.array(gaps[rows, near.ravel()])], names=["query", "dst", "dist"])

    found = points.mapInArrow(search, f"query int, dst {kind}, dist double")
    found = found.join(F.broadcast(points.sparkSession.createDataFrame(list(enumerate(names)), f"query int, id {kind}")), "query").where("dst <> id")
    order = Window.partitionBy("id").orderBy("dist", "dst")
    rows = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("id").agg(F.collect_set("dst").alias("true")).collect()
    return {r["id"]: set(r["true"]) for r in rows}


def _recall(lists: DataFrame, truth: dict) -> float:
    """Share of true neighbours in the lists, less two standard errors."""
    if not truth:
        return 1.0
    rows = lists.where(F.col("id").isin(list(truth))).groupBy("id").agg(F.collect_set("dst").alias("dst")).collect()
    shares = np.array([len(truth[r["id"]] & set(r["dst"])) / len(truth[r["id"]]) for r in rows])
    return float(shares.mean() - 2 * shares.std() / math.sqrt(len(shares)))
