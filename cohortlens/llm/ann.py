"""Nearest neighbours by largest inner product, through collision counting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import groups
from cohortlens.llm.vectors import matrix, sound_vectors
from cohortlens.session import materialize

# Projections, and the share of them a vector must collide in.
PROJECTIONS, COLLIDING = 160, 0.6
# Half width of the first window and its largest growth per round, in units of the ring's longest vector.
WIDTH, GROWTH = 0.6, 1.4
# A query is done when its windows are so many times as wide as the distance of its k-th verified vector. Each window then
# holds a vector at that distance with probability 0.683, and at least COLLIDING of all windows with probability 0.988.
REACH = 1.0
# The shortest vector of a ring, in units of its longest; a ring goes on to shorter ones until it has so many vectors.
RING, LEAST = 0.85, 512
# Rows, and queries, that meet in one task.
ROW_BLOCK, QUERY_BLOCK = 1 << 16, 512


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows that are not zero, without overflow on the way."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def rings(length: np.ndarray) -> list[np.ndarray]:
    """Rows dealt by length, the longest first, into rings of similar length, but of at least ``LEAST`` rows if there are."""
    order = np.argsort(-length, kind="stable")
    falling, out, at = -length[order], [], 0
    while at < len(order):
        end = max(int(np.searchsorted(falling, falling[at] * RING, side="right")), at + LEAST)
        out.append(order[at:end])
        at = end
    return out


class Collisions:
    """An index of one ring of a block: each projection's values in order.

    In units of ``longest``, a vector gets one more component that brings its length to 1; a query is brought to
    length 1 and gets 0 there, so that the smaller their distance, the larger their inner product. A query opens a
    window around its own projection in each array and widens all of them round by round (virtual rehashing: windows of
    any width are found in the same arrays). Vectors whose ranks lie in the windows of a ``COLLIDING`` share of the
    arrays are verified.
    """

    def __init__(self, x: np.ndarray, longest: float, seed: int = 1):
        self.n, x = len(x), x / longest
        self.a = np.random.default_rng(seed).normal(size=(x.shape[1] + 1, PROJECTIONS))
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        values = x @ self.a[:-1] + rest[:, None] * self.a[-1]
        order = np.argsort(values, axis=0)
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, 0).T)
        self.rank = np.empty((PROJECTIONS, self.n), dtype=np.uint16 if self.n < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, order.T, np.arange(self.n, dtype=self.rank.dtype)[None, :], axis=1)

    def colliding(self, at: np.ndarray, width: float) -> np.ndarray:
        """Which rows lie in enough windows of half width ``width`` around the query's projections ``at``."""
        counts, moved, inside = np.zeros(self.n, dtype=np.uint8), np.empty_like(self.rank[0]), np.empty(self.n, dtype=bool)
        kind = self.rank.dtype.type
        for values, rank, x in zip(self.sorted, self.rank, at.tolist()):
            low, high = values.searchsorted(x - width), values.searchsorted(x + width, side="right")
            # Ranks below the window wrap around to large numbers.
            np.subtract(rank, kind(low), out=moved)
            np.less(moved, kind(high - low), out=inside)
            counts += inside.view(np.uint8)
        return counts >= COLLIDING * PROJECTIONS


class Best:
    """The largest products a query has met so far: rows and rough products, of which the ``k`` th is the bound."""

    def __init__(self, k: int):
        self.k, self.rows, self.rough, self.bound = k, np.zeros(0, dtype=np.int64), np.zeros(0), -math.inf

    def add(self, rows: np.ndarray, rough: np.ndarray) -> None:
        """Rows below the bound by more than rounding can explain are let go."""
        keep = rough >= self.bound - 1e-9 * (1.0 + abs(self.bound)) if math.isfinite(self.bound) else slice(None)
        self.rows, self.rough = np.concatenate([self.rows, rows[keep]]), np.concatenate([self.rough, rough[keep]])
        if len(self.rows) > self.k:
            self.bound = float(np.partition(self.rough, -self.k)[-self.k])
            keep = self.rough >= self.bound - 1e-9 * (1.0 + np.abs(self.rough).max())
            self.rows, self.rough = self.rows[keep], self.rough[keep]
        elif len(self.rows) == self.k:
            self.bound = float(self.rough.min())


class Block:
    """The rows of one task, ring by ring."""

    def __init__(self, x: np.ndarray):
        self.x, length = x, lengths(x)
        self.rings = []
        for rows in rings(length):
            longest = float(length[rows[0]])
            self.rings.append((rows, longest, Collisions(x[rows], longest)))

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query the rows, but for its own, that hold the ``k`` largest products found.

        Rings come longest first. A ring ends when no vector of it that is nearer than the ``k`` th verified one is
        likely to be missing; the search ends when no vector as short as the next ring's can reach the ``k`` th product.
        """
        length = lengths(queries)
        unit, best = queries / length[:, None], [Best(k) for _ in queries]
        for rows, longest, index in self.rings:
            # A vector of the ring has at most this product.
            open_ = [i for i in range(len(queries)) if best[i].bound <= length[i] * longest * (1 + 1e-9)]
            if not open_:
                break
            start = WIDTH
            for i in open_:
                def verify(fresh: np.ndarray) -> float:
                    """Takes rows of the ring; the distance of the k-th verified vector, were it of this ring."""
                    fresh = rows[fresh]
                    fresh = fresh[ids[fresh] != own[i]]
                    rough = (self.x @ queries[i])[fresh] if 4 * len(fresh) > len(self.x) else self.x[fresh] @ queries[i]
                    best[i].add(fresh, rough)
                    return math.sqrt(max(0.0, 2.0 * (1.0 - best[i].bound / length[i] / longest)))

                at, width, seen, apart = unit[i] @ index.a[:-1], start / GROWTH, np.zeros(len(rows), dtype=bool), math.inf
                while width < REACH * apart and not seen.all():
                    width = min(width * GROWTH, REACH * apart)
                    fresh = index.colliding(at, width) & ~seen
                    seen |= fresh
                    apart = verify(np.flatnonzero(fresh))
                # The next query begins about where the ones before it ended.
                if math.isfinite(apart):
                    start = max(WIDTH, (start + 1.03 * REACH * apart) / 2)
        for b in best:
            yield b.rows


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products row by row, so that equal rows have equal results to the last bit."""
    return (x * query).sum(axis=1)


def nearest(
    df: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with an id divisible by ``every`` the ``k`` rows found nearest.

    Nearness is the largest inner product in double precision, ties to the smaller id; a query is never its own
    neighbour, and fewer than ``k`` others are all listed. All rows are searched, in blocks of about ``row_block``
    that each block of queries meets; a task holds one of either and passes on at most ``k`` rows per query. Whatever the
    vectors' lengths, a row that belongs to the ``k`` is missed with a probability of about 0.012 at most (``REACH``).

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
    id, which must be a whole number; only vectors of one length meet. Repeated rows count once. An empty table gives an empty result.
    """
    rows = materialize(sound_vectors(df, key, vector).withColumn("dim", F.size("vec")), "vectors")
    n = rows.count()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = rows.where(F.col("id") % every == 0)
    row_parts, query_parts = max(1, math.ceil(n / row_block)), max(1, math.ceil(queries.count() / query_block))
    row_part, query_part = F.pmod(F.xxhash64("id"), F.lit(row_parts)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(query_parts)).cast("int")
    sides = rows.select("dim", row_part.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("q"), F.lit(False).alias("asks"), "id", "vec")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))).alias("r"), query_part.alias("q"), F.lit(True).alias("asks"), "id", "vec")
    keys = ["dim", "r", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            x, ids = matrix(table["vec"]), table["id"].to_numpy()
            order = np.argsort(ids[~asks], kind="stable")
            base, base_ids = x[~asks][order], ids[~asks][order]
            order = np.argsort(ids[asks], kind="stable")
            queries_, query_ids = x[asks][order], ids[asks][order]
            block = Block(base)
            for at in range(0, len(query_ids), 64):
                some = slice(at, at + 64)
                out = []
                for query, own, found in zip(queries_[some], query_ids[some].tolist(), block.search(queries_[some], query_ids[some], base_ids, k)):
                    score = products(base[found], query)
                    best = np.lexsort((base_ids[found], -score))[:k]
                    out.append((np.full(len(best), own), base_ids[found][best], score[best]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"]
                )

    dealt = sides.union(asked).repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
