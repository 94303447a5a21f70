"""Exact all-pairs work in bounded blocks.

Some questions (nearest neighbours, mean distances) need the distance of every
point to many others. Here the points are cut into blocks of a set size, each
task receives two blocks, and only its small summary leaves the task: pairs are
never rows. A group of any size is cut up, so no key can fill a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Points per block: two blocks of this size and their distances take tens of megabytes.
BLOCK = 2048
# Where all meet all, points of a block on the one side and on the other at most; a point is sent once to each block of the other side, so that
# larger blocks mean less to send. Fewer points give smaller blocks on the one side, about ``SIDES`` of them, so that there are tasks enough.
OWN, OTHERS, SIDES = 16_384, 65_536, 24
# Rounding of single precision.
_ROUGH = float(np.finfo(np.float32).eps)
# Rows and columns of a product of two blocks that are looked at together.
ROWS, COLUMNS = 512, 4096


def block_count(rows: int, block: int) -> int:
    """Blocks needed so that hashing seldom fills one beyond ``block``."""
    return max(1, math.ceil(rows * 1.25 / block))


def block_of(key: Column, blocks: Column | int) -> Column:
    """A block number from the hash of a unique key; equal shares for any distribution of values."""
    return F.pmod(F.xxhash64(key), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 0))


def arrow_matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The same of an Arrow column of lists, all equally long; a null component is NaN."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = whole.value_lengths()
    if sizes.null_count or len(sizes.unique()) > 1:
        raise ValueError("vectors are null or differ in length")
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two blocks, summed coordinate by coordinate (no cancellation)."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def own_block(rows: int) -> int:
    """Points of a block on the one side, for so many in all."""
    return max(1024, min(OWN, rows // SIDES))


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``(left, right, margin, scale)``: ``left @ right.T`` are squared distances of two blocks of finite points, times ``scale ** 2``.

    One product of matrices is many times faster than sums by coordinate, and loses digits of small distances: a row is off by at most its ``margin``.
    """
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    scale = 2.0 ** -float(np.clip(np.frexp(top)[1], 0, 1000))
    a, b = a * scale, b * scale
    centre = b.mean(axis=0) if len(b) else np.zeros(b.shape[1])
    a, b = a - centre, b - centre
    square_a, square_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    margin = 8 * np.finfo(float).eps * (a.shape[1] + 8) * (np.sqrt(square_a) + np.sqrt(square_b.max(initial=0.0))) ** 2
    left = np.column_stack([-2.0 * a, square_a, np.ones(len(a))])
    right = np.column_stack([b, np.ones(len(b)), square_b])
    return left, right, margin, scale


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of the one to the same row of the other, with the same digits as :func:`distances`."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        gap = a[:, i] - b[:, i]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def nearest_others(names: np.ndarray, mine: np.ndarray, ids: np.ndarray, theirs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of mine, row of theirs, distance)`` of the ``k`` nearest with another id, ties by the lower row of theirs.

    Products find what may be near enough, margins included, in single precision where its margin is small beside the distances; only what is left
    at the end is measured by coordinate. Points that are not finite have no neighbours and are none.
    """
    own, other = np.flatnonzero(np.isfinite(mine).all(axis=1)), np.flatnonzero(np.isfinite(theirs).all(axis=1))
    if not len(own) or not len(other):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    x, y = mine[own], theirs[other]
    left, right, margin, scale = products(x, y)
    rough, rough_right, rough_margin = left.astype(np.float32), right.astype(np.float32), margin * (_ROUGH / np.finfo(float).eps) + 1e-30
    # Rows of theirs that a row of mine may have to leave out.
    copies = int(pd.Series(ids).value_counts(dropna=False).max())
    out = []
    for at in range(0, len(x), ROWS):
        part, against, slack = left[at : at + ROWS], right, margin[at : at + ROWS]
        bound = np.full(len(part), np.inf)
        rows, cols, gap = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for to in range(0, len(y), COLUMNS):
            gaps = part @ against[to : to + COLUMNS].T
            if not to and gaps.shape[1] > k + copies:
                bound = np.partition(gaps, k + copies - 1, axis=1)[:, k + copies - 1] + 2 * slack
            # Rounded up, where products are in single precision.
            r, c = np.nonzero(gaps <= (bound * (1 + _ROUGH)).astype(gaps.dtype)[:, None])
            apart = names[own[at + r]] != ids[other[to + c]]
            r, c = r[apart], c[apart]
            if len(r):
                rows, cols, gap = np.concatenate([rows, r]), np.concatenate([cols, c + to]), np.concatenate([gap, gaps[r, c]])
                # Who is measured k-th is no farther than who is k-th by products, but for the slack of either.
                rows, cols, gap, last = _first(rows, cols, gap, len(part), k, 2 * slack)
                bound = np.minimum(bound, last + 2 * slack)
                if len(rows) > 8 * k * len(part):
                    rows, cols, dist = _measured(x, y, at, rows, cols, k)
                    gap = (dist * scale) ** 2
            if not to and np.median(rough_margin[at : at + ROWS]) <= 1e-2 * np.median(bound):
                part, against, slack = rough[at : at + ROWS], rough_right, rough_margin[at : at + ROWS]
                bound = bound + 2 * slack
        rows, cols, dist = _measured(x, y, at, rows, cols, k)
        out.append((own[at + rows], other[cols], dist))
    return tuple(np.concatenate(v) for v in zip(*out))


def _first(rows: np.ndarray, cols: np.ndarray, gap: np.ndarray, n: int, k: int, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each of ``n`` rows, what is at most ``more`` beyond the ``k``-th gap, and that gap (infinite where there are fewer)."""
    order = np.lexsort((gap, rows))
    rows, cols, gap = rows[order], cols[order], gap[order]
    first = np.searchsorted(rows, np.arange(n + 1))
    full = np.flatnonzero(np.diff(first) >= k)
    last = np.full(n, np.inf)
    last[full] = gap[first[full] + k - 1]
    kept = gap <= (last + more)[rows]
    return rows[kept], cols[kept], gap[kept], last


def _measured(x: np.ndarray, y: np.ndarray, at: int, rows: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, the ``k`` nearest measured by coordinate, ties by the lower column; rows count from ``at``."""
    dist = np.concatenate([pair_distances(x[at + rows[i : i + COLUMNS]], y[cols[i : i + COLUMNS]]) for i in range(0, len(rows), COLUMNS)] or [np.zeros(0)])
    sound = np.flatnonzero(np.isfinite(dist))
    order = sound[np.lexsort((cols[sound], dist[sound], rows[sound]))]
    rows, cols, dist = rows[order], cols[order], dist[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept], dist[kept]


def sums_by_label(a: np.ndarray, b: np.ndarray, weight: np.ndarray, label: np.ndarray, labels: int) -> np.ndarray:
    """Per row of ``a`` and label, the weighted sum of the distances to the rows of ``b`` with that label (``0 .. labels - 1``).

    Distances that are small beside the coordinates are measured by coordinate, the others by products, to some eleven digits of the largest.
    """
    out = np.zeros((len(a), labels))
    order = np.argsort(label, kind="stable")
    b, weight, label = b[order], weight[order], label[order]
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        for to in range(0, len(b), ROWS):
            for at in range(0, len(a), ROWS):
                gaps = distances(a[at : at + ROWS], b[to : to + ROWS]) * weight[to : to + ROWS]
                starts = np.flatnonzero(np.diff(label[to : to + ROWS], prepend=-1))
                out[at : at + ROWS, label[to + starts]] += np.add.reduceat(gaps, starts, axis=1)
        return out
    left, right, margin, scale = products(a, b)
    for to in range(0, len(b), COLUMNS):
        starts = np.flatnonzero(np.diff(label[to : to + COLUMNS], prepend=-1))
        for at in range(0, len(a), ROWS):
            gaps = left[at : at + ROWS] @ right[to : to + COLUMNS].T
            r, c = np.nonzero(gaps <= 1e7 * margin[at : at + ROWS, None])
            np.sqrt(np.maximum(gaps, 0.0, out=gaps), out=gaps)
            gaps /= scale
            for some in range(0, len(r), COLUMNS * 16):
                i, j = r[some : some + COLUMNS * 16], c[some : some + COLUMNS * 16]
                gaps[i, j] = pair_distances(a[at + i], b[to + j])
            gaps *= weight[to : to + COLUMNS]
            out[at : at + ROWS, label[to + starts]] += np.add.reduceat(gaps, starts, axis=1)
    return out


def bundles(pivots: np.ndarray, counts: dict[int, int], size: int) -> np.ndarray:
    """The bundle of each cell: cells along a path through the pivots, until they hold ``size`` points."""
    out, left, at, held, number = np.zeros(len(pivots), dtype=int), np.ones(len(pivots), dtype=bool), 0, 0, 0
    while left.any():
        left[at] = False
        own = counts.get(at, 0)
        if held and held + own > size:
            number, held = number + 1, 0
        out[at], held = number, held + own
        away = np.where(left, distances(pivots[at : at + 1], pivots)[0], np.inf)
        at = int(away.argmin())
        if not left[at] and left.any():  # no distance is a number
            at = int(np.flatnonzero(left)[0])
    return out


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and distance to, the nearest centre; the lowest index wins ties."""
    gaps = distances(vectors, centres)
    index = gaps.argmin(axis=1)
    return index, gaps[np.arange(len(vectors)), index]


def with_nearest(df: DataFrame, centres: np.ndarray, vector: str = "vec", index: str = "centre", gap: str | None = None) -> DataFrame:
    """Add the nearest of a bounded set of centres to each row, batch by batch."""
    added = [T.StructField(index, T.IntegerType())] + ([T.StructField(gap, T.DoubleType())] if gap else [])
    schema = T.StructType(df.schema.fields + added)

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            found, away = [], []
            vectors = matrix(pdf[vector])
            for at in range(0, len(vectors), BLOCK):
                i, d = nearest(vectors[at : at + BLOCK], centres)
                found.append(i)
                away.append(d)
            pdf[index] = np.concatenate(found).astype("int32")
            if gap:
                pdf[gap] = np.concatenate(away)
            yield pdf

    return df.mapInPandas(assign, schema)
