"""Near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain as chain_
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import components, mix
from cohortlens.llm.vectors import sound_vectors
from cohortlens.session import materialize

# Centres of each half's codebook; vectors it is fitted on, at most; vectors that a task holds, where there are more.
CENTRES, FIT_ROWS, BLOCK = 32, 4096, 2048
# Of a large table: tasks that hold the vectors, at least, unless these take more bytes each; cells of a product of matrices.
GROUPS, HOME_BYTES, TILE = 128, 1 << 25, 1 << 20


def distances(a: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] - 2 * a @ centres.T + (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def lloyd(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """``k`` centres (fewer if there are fewer distinct points); a bounded sample only."""
    points = np.unique(points, axis=0)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = distances(points, centres).argmin(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = points[own == j].mean(axis=0)
    return centres


class MultiIndex:
    """Two codebooks, one for each half of a vector; a cell is a pair of centres.

    How far a vector is from a cell is the sum of squares, over the halves, of its distance to the cell's centre
    beyond its distance to the nearest one: 0 for its own cell. ``slack`` bounds the cells it visits. It is set so that
    of random pairs exactly at the similarity bound at least ``recall`` meet, that is one of the two visits the
    other's cell; closer pairs meet more surely.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, width: int, slack: float):
        self.first, self.second, self.width, self.slack = first, second, width, slack

    @classmethod
    def fit(cls, sample: np.ndarray, similarity: float, recall: float, centres: int = CENTRES, seed: int = 1) -> MultiIndex:
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        half = (width + 1) // 2
        index = cls(lloyd(sample[:, :half], centres, rng), lloyd(sample[:, half:], centres, rng), width, 0.0)
        x = sample[rng.integers(0, len(sample), 4000)]
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(axis=1)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
        y = similarity * x + np.sqrt(1 - similarity**2) * aside
        (ex, cx), (ey, cy) = index.excess(x), index.excess(y)
        at = np.arange(len(x))
        need = np.minimum(
            ex[0][at, cy[0]] ** 2 + ex[1][at, cy[1]] ** 2, ey[0][at, cx[0]] ** 2 + ey[1][at, cx[1]] ** 2
        )
        index.slack = float(np.quantile(need, recall))
        return index

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def home(self, unit: np.ndarray) -> np.ndarray:
        first, second = self.excess(unit)[1]
        return first * len(self.second) + second

    def excess(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        half = (self.width + 1) // 2
        over, own = [], []
        for part, centres in ((unit[:, :half], self.first), (unit[:, half:], self.second)):
            gap = distances(part, centres)
            own.append(gap.argmin(axis=1))
            over.append(gap - gap.min(axis=1)[:, None])
        return over, own

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell of each vector, and the other cells it visits, nearest first (multi-sequence traversal)."""
        over, own = self.excess(unit)
        across = len(self.second)
        visited = []
        for a, b in zip(over[0] ** 2, over[1] ** 2):
            order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            x, y = a[order[0]].tolist(), b[order[1]].tolist()
            first, second = order[0].tolist(), order[1].tolist()
            heap, cells = [(x[0] + y[0], 0, 0)], []
            while heap:
                cost, i, j = heapq.heappop(heap)
                if cost > self.slack:
                    break
                cells.append(first[i] * across + second[j])
                if j + 1 < len(y):
                    heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(x):
                    heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
            visited.append(cells)
        cell = own[0] * across + own[1]
        return cell, [[c for c in v if c != home] for v, home in zip(visited, cell.tolist())]


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # first to a safe range, so that no square overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def homes(classes: DataFrame, index: MultiIndex) -> np.ndarray:
    """How many classes each cell is the home of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(index.cells, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                vectors = [np.array(v) for v in batch.column(0).slice(at, 1024).to_pylist()]
                n += np.bincount(index.home(_unit(_padded(vectors, index.width))), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], names=["cell", "n"])

    out = np.zeros(index.cells, dtype=np.int64)
    for cell, n in classes.select("vec").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


class Tasks:
    """Which tasks hold the vectors at home in a cell: ``parts`` tasks from ``start`` on, none for a cell without any.

    Cells side by side share a task up to ``most`` vectors, so that a vector which visits several is sent once to all of them. A cell of
    more is dealt by the hash of the id.
    """

    def __init__(self, sizes: np.ndarray, order: list[int], most: int):
        self.start, self.parts = np.zeros(len(sizes), dtype=np.int64), -(-sizes // most)
        self.n, held = 0, most
        for cell in order:
            size = int(sizes[cell])
            if not size:
                continue
            if held + size > most:
                self.start[cell], held = self.n, size
                self.n += int(self.parts[cell])
            else:
                self.start[cell], held = self.n - 1, held + size


def chain(centres: np.ndarray) -> list[int]:
    """Centres in an order in which one follows another near it."""
    order, left = [0], set(range(1, len(centres)))
    while left:
        gap = distances(centres[order[-1:]], centres)[0]
        order.append(min(left, key=gap.__getitem__))
        left.discard(order[-1])
    return order


def routed(classes: DataFrame, index: MultiIndex, tasks: Tasks) -> DataFrame:
    """``(part, dim, guest, id, copies, home, cells, vec, seen)``: each vector once in the task that holds its home and once in each that holds cells it visits.

    ``cells`` are the cells of that task it visits, its home among them; ``seen`` a bit for each cell it visits anywhere, at home only.
    Vectors go as single precision where that is exact.
    """

    def sent(part: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [np.array(v) for v in part.column("vec").to_pylist()]
        home, visits = index.visits(_unit(_padded(vectors, index.width)))
        owner = np.repeat(np.arange(len(home)), [len(v) + 1 for v in visits])
        cell = np.array([c for h, v in zip(home.tolist(), visits) for c in (h, *v)], dtype=np.int64)
        seen = np.zeros((len(home), index.cells), dtype=bool)
        seen[owner, cell] = True
        # A row for each task that holds some of a cell.
        times = tasks.parts[cell]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner, cell = np.repeat(owner, times), np.repeat(cell, times)
        task = tasks.start[cell] + step
        order = np.lexsort((cell, task, owner))
        owner, cell, task = owner[order], cell[order], task[order]
        first = np.flatnonzero(np.diff(owner * tasks.n + task, prepend=-1))
        owner, task, offsets = owner[first], task[first], np.append(first, len(cell))
        ids = part.column("id").to_numpy()
        own = tasks.start[home] + (mix(ids.view(np.uint64)) % tasks.parts[home].astype(np.uint64)).astype(np.int64)
        at_home = own[owner] == task
        with np.errstate(over="ignore"):
            short = [v.astype(np.float32) for v in vectors]
        coded = [(f if (f == v).all() else v).tobytes() for f, v in zip(short, vectors)]
        bits = pa.array([b.tobytes() for b in np.packbits(seen, axis=1)], pa.binary())
        take = pa.array(owner, pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(task, pa.int32()), pa.array([len(v) for v in vectors], pa.int32()).take(take), pa.array(1 - at_home.astype(np.int32)),
            part.column("id").take(take), part.column("copies").take(take), pa.array(home, pa.int32()).take(take),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cell, pa.int32())), pa.array(coded, pa.binary()).take(take),
            bits.take(pa.array(owner, pa.int32(), mask=~at_home)),
        ], names=["part", "dim", "guest", "id", "copies", "home", "cells", "vec", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield sent(batch.slice(at, 1024))

    schema = "part int, dim int, guest int, id bigint, copies bigint, home int, cells array<int>, vec binary, seen binary"
    return classes.mapInArrow(run, schema)


def _decoded(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components, each sent in single or double precision, as rows of a matrix."""
    out = np.empty((len(column), dim))
    for row, data in zip(out, column):
        data = data.as_buffer()
        row[:] = np.frombuffer(data, np.float32 if data.size == 4 * dim else np.float64)
    return out


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Groups, named by their least member, after the links ``i - j``, and the places of links enough to join what was apart."""
    place, told = np.arange(len(i)), []
    while True:
        a, b = root[i[place]], root[j[place]]
        apart = a != b
        if not apart.any():
            return root, told
        place, a, b = place[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        hooks = order[np.flatnonzero(np.diff(high[order], prepend=-1))]  # of each group the link to the least one
        told += place[hooks].tolist()
        up = np.arange(len(root))
        up[high[hooks]] = low[hooks]
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


class Block:
    """The vectors at home in one task, which the others that visit its cells meet slice by slice."""

    def __init__(self, rows: pa.Table, dim: int, similarity: float):
        rows = rows.take(pa.array(np.argsort(rows["home"].to_numpy(), kind="stable")))
        self.rows, self.dim, self.similarity = rows, dim, similarity
        self.ids, self.copies, self.home = (rows[c].to_numpy() for c in ("id", "copies", "home"))
        self.seen = np.frombuffer(b"".join(rows["seen"].to_pylist()), np.uint8).reshape(len(rows), -1)
        self.unit = _unit(_decoded(rows["vec"], dim))
        self.short = self.unit.astype(np.float32)
        # Single precision tells but for this much.
        self.doubt = (dim + 8) * 2.0**-23
        cells, starts = np.unique(self.home, return_index=True)
        self.bounds = dict(zip(cells.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(rows)])))
        self.n, self.root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))

    def met(self, rows: pa.Table, own: int | None = None) -> pa.RecordBatch:
        """Links of vectors with those at home here; ``own``: the place of the first one here, if they are at home here themselves."""
        ids, copies, home = (rows[c].to_numpy() for c in ("id", "copies", "home"))
        unit = _unit(_decoded(rows["vec"], self.dim))
        short = unit.astype(np.float32)
        lists = rows["cells"].combine_chunks()
        cell = lists.flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        visitor, cell = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))[order], cell[order]
        # Places: those at home here first, then guests.
        place = len(self.ids) + np.arange(len(ids)) if own is None else own + np.arange(len(ids))
        root = np.concatenate([self.root, place]) if own is None else self.root
        n, a, b = np.zeros(len(ids), dtype=np.int64), [], []
        name = np.concatenate([self.ids, ids]) if own is None else self.ids
        for start, end in zip(edges := np.flatnonzero(np.diff(cell, prepend=-1)), [*edges[1:], len(cell)]):
            if int(cell[start]) not in self.bounds:
                continue
            who, (low, high) = visitor[start:end], self.bounds[int(cell[start])]
            wide = max(1, TILE // len(who))
            for at in range(low, high, wide):
                cosine = short[who] @ self.short[at : min(high, at + wide)].T
                i, j = np.nonzero(cosine >= self.similarity - self.doubt)
                if not len(i):
                    continue
                open_ = np.flatnonzero(cosine[i, j] < self.similarity + self.doubt)
                i, j = who[i], at + j
                keep = place[i] != j
                # In one order of summation, so that the block does not matter; some at a time.
                for k in range(0, len(open_), step := max(1, TILE // self.dim)):
                    some = open_[k : k + step]
                    keep[some] &= (unit[i[some]] * self.unit[j[some]]).sum(axis=1) >= self.similarity
                i, j = i[keep], j[keep]
                # If each visits the other's home, the pair counts at the lesser one only.
                back = self.seen[j, home[i] >> 3] >> (7 - (home[i] & 7)) & 1 == 1
                first = (ids[i] > self.ids[j]) | ((ids[i] == self.ids[j]) & (place[i] > j))
                keep = ~back | (self.home[j] < home[i]) | ((self.home[j] == home[i]) & first)
                i, j = i[keep], j[keep]
                np.add.at(n, i, self.copies[j])
                np.add.at(self.n, j, copies[i])
                root, told = united(root, place[i], j)
                a += name[place[i][told]].tolist()
                b += name[j[told]].tolist()
        # A group that a vector at home here is in bears the place of one.
        self.root = root[: len(self.ids)]
        if own is not None:
            self.n[own : own + len(ids)] += n
            n = n[:0]
        return _told(ids, n, a, b)


def _told(ids: np.ndarray, n: np.ndarray, a: list[int], b: list[int]) -> pa.RecordBatch:
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([
        pa.array([*ids[some].tolist(), *a], pa.int64()), pa.array([*[None] * len(some), *b], pa.int64()), pa.array([*n[some].tolist(), *[0] * len(a)], pa.int64()),
    ], names=["a", "b", "n"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows side by side with equal keys, as they come."""
    for batch in batches:
        columns = np.array([batch.column(k).to_numpy() for k in keys])
        change = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for at, end in zip(bounds, bounds[1:]):
            if end > at:
                yield tuple(columns[:, at].tolist()), pa.Table.from_batches([batch.slice(at, end - at)])


def linked(placed: DataFrame, tasks: Tasks, similarity: float) -> DataFrame:
    """``(a, b, n)``: per task, links enough to connect what is linked (``b`` set), and how many vectors each links with (``n``)."""

    def met(block: Block, rows: pa.Table, own: bool = False) -> Iterator[pa.RecordBatch]:
        step = max(64, TILE // block.dim)
        for at in range(0, len(rows), step):
            out = block.met(rows.slice(at, step).combine_chunks(), at if own else None)
            if out.num_rows:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim), stretches in groupby(_runs(batches, ["part", "dim", "guest"]), key=lambda x: x[0][:2]):
            held, block = [], None
            for (*_, guest), rows in chain_(stretches, [((0, 0, 1), None)]):  # at the end as if a guest came
                if not guest:
                    held.append(rows)
                    continue
                if held and block is None:
                    block = Block(pa.concat_tables(held), dim, similarity)
                    held = []
                    yield from met(block, block.rows, own=True)
                if block is not None and rows is not None:
                    yield from met(block, rows)
            if block is not None and block.n.any():
                yield _told(block.ids, block.n, [], [])

    # Partitions keep their number: a small one may be long work.
    dealt = placed.repartitionById(tasks.n, F.col("part")).sortWithinPartitions("part", "dim", "guest")
    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicates(
    df: DataFrame, similarity: float = 0.9, recall: float = 0.995, centres: int = CENTRES, fit_rows: int = FIT_ROWS,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row of ``df``.

    Two vectors of one length are linked when their cosine, in double precision, is at least ``similarity`` and
    they meet in a cell (see :class:`MultiIndex`; ``recall`` is for pairs at the bound). ``n_links`` counts the other
    ids linked directly, ``component_id`` is the smallest id reachable.

    Equal vectors are one class with a count, so copies cost nothing. Codebooks are fitted on at most
    ``fit_rows`` classes, chosen by a hash of the id; every class is indexed. Each vector is sent once to each task with
    cells it visits; the task holds the vectors at home there, and the others pass it slice by slice. Links are
    counted there and only a spanning forest leaves a task. Time within a group of distinct vectors that are all alike still grows with its square, since each link is counted.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
    without an id, whose component is null. Repeated rows count once and all appear in the result.
    """
    rows = materialize(sound_vectors(df, key, vector), "vectors")
    classes = materialize(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    sample = [np.array(r.vec) for r in classes.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").collect()]
    every = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("vec"))
    if not sample:
        return every.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = classes.agg(F.max(F.size("vec"))).first()[0]
    index = MultiIndex.fit(_unit(_padded(sample, width)), similarity, recall, centres)
    sizes = homes(classes, index)
    most = max(BLOCK, min(int(sizes.sum()) // GROUPS, HOME_BYTES // (8 * width)))
    tasks = Tasks(sizes, [i * len(index.second) + j for i in chain(index.first) for j in chain(index.second)], most)
    found = materialize(linked(routed(classes, index, tasks), tasks, similarity), "links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    reps = classes.select("vec", F.col("id").alias("rep"), "copies").join(counts, "rep", "left")
    joined = materialize(rows.join(reps, "vec").select("id", "vec", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "counted")
    copies = joined.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    whole = components(found.where("b IS NOT NULL AND a <> b").select("a", "b").union(copies), "near")
    out = every.join(joined.select("id", "vec", "n_links"), ["id", "vec"], "left").join(whole, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
