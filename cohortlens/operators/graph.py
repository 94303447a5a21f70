"""Components, spectral layout and clusters of a weighted graph.

Edges and vertices are stored in buckets of the vertex, equally many, so that a product of the adjacency with
vectors joins bucket with bucket and shuffles only the sums that each bucket makes for the vertices of the others.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import discard, materialize, scratch_path

# Growth of the wanted directions over the rest in one cycle: its square must leave digits in a Gram matrix.
GROWTH = 1e5
# Edges of a bucket, at least, where there are several.
BUCKET_EDGES = 250_000
# Residual of coordinates beside the distance of their values, at most; values nearer to each other are equal.
NEAR, EQUAL = 1e-3, 1e-9
# Products of a cycle at most; products between two looks at the change; values that a clustering of one coordinate works on.
CYCLE, LOOK, BINS = 64, 4, 2048
# Buckets that the edges of a component laid out in one task may fill; vertices of one that need no elimination; solutions at most, and vectors of one.
TASK_BUCKETS, CORE, MOST_SOLVES, AT_ONCE = 2, 256, 100, 4


class Bucketed:
    """Tables of one computation, bucketed by a vertex, whose files go when they are no longer read."""

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        # As many as shuffles have partitions, so that sums arrive where they are needed; fewer for few edges.
        self.buckets = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // BUCKET_EDGES)))
        self.held: dict[str, str] = {}

    def store(self, df: DataFrame, key: str, label: str) -> DataFrame:
        name, path = f"cohortlens_{label}_{uuid.uuid4().hex}", scratch_path(self.spark, label)
        df.write.format("parquet").option("path", path).bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        self.held[name] = path
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """Remove all tables but the ``keep`` last ones."""
        for name in list(self.held)[: len(self.held) - keep]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self.held.pop(name))


def both_ways(graph: DataFrame) -> DataFrame:
    """Each edge ``(src, dst, weight)`` in both directions; loops and edges without a positive weight play no part."""
    edges = graph.select("src", "dst", F.col("weight").cast("double").alias("weight")).where("src <> dst AND weight > 0")
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)``: for every id in ``edges(a, b)`` the smallest id it is connected with.

    Alternating stars: each id sends its larger neighbours, then its smaller ones, to the smallest
    id it knows, until nothing changes; the number of rounds grows with the logarithm of the longest
    chain. Minima are merged before each shuffle, joins may be split by adaptive execution, every
    round is written to the shared folder and the one before it removed. Null ids and loops are ignored.
    """
    table = materialize(edges.select("a", "b").where("a <> b").distinct(), label)
    state = None
    while True:
        new_state = tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new_state == state or not new_state[0]:
            break
        state = new_state
        both = table.union(table.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = materialize(larger, label)
        low = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = low.groupBy("u").agg(F.min("v").alias("m"))
        smaller = low.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        fresh = materialize(smaller.union(root).distinct().toDF("a", "b"), label)
        discard(table.sparkSession, table)
        discard(table.sparkSession, stars)
        table = fresh
    # A star now: every id but the smallest points at the smallest.
    return table.union(table.select("b", "b")).groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")


# --- spectral layout -----------------------------------------------------------------


def spectral_embedding(
    graph: DataFrame, dims: int = 2, extra: int = 9, prefix: str = "Embedding_", tolerance: float = 1e-4, most_products: int = 5000
) -> DataFrame:
    """``(id, component, residual, <prefix>1 ..)``: coordinates from the smoothest non-constant functions on the graph.

    In each connected component (named by its least id) these are the leading eigenvectors of the normalised adjacency
    ``A`` after the trivial one, of length 1 and signed so that the largest coordinate is positive; a component with fewer
    eigenvectors has zeros. ``residual`` is the greatest ``|A x - value x|`` of the component's coordinates as measured, at most
    ``tolerance`` unless ``most_products`` ran out. Vertices are those with an edge of positive weight to another.

    A block of ``dims + extra`` vectors, orthogonal to the trivial one, goes through cycles: a Chebyshev polynomial of ``A``
    that is small on ``[-1, m]``, ``m`` being the block's least value so far, and large above; then the best combinations
    (Rayleigh-Ritz) from the inner products of the vectors and their products, a small matrix per component. The degree follows from how
    far the values lie apart. A product is one join of stored buckets and one sum per vertex, partial before
    the only shuffle, and is written out. Sums are taken in double precision, so the
    partitioning changes last digits only; but where several values are equal, any mixture of their vectors is as good, and rounding chooses.

    A component whose edges fit ``TASK_BUCKETS`` buckets goes through the same cycles in the one task that holds it, where a product is no
    job of its own; there it goes on until the residual is small beside the distance of the values as well, which close values need to be told apart.
    Paths, trees and what else is left with few vertices by :class:`Elimination` there take a few exact solutions in place of cycles, whatever their length.
    A larger one that :class:`Reduced` brings down so far takes them as well, as jobs.
    """
    spark, width = graph.sparkSession, dims + extra
    edges = materialize(both_ways(graph), "edges")
    degree = materialize(edges.groupBy("src").agg(F.sum("weight").alias("degree")), "degree")
    far = degree.select(F.col("src").alias("dst"), F.col("degree").alias("far"))
    scaled = edges.join(degree, "src").join(far, "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("degree") * F.col("far"))).alias("w"))
    noise = [f"pmod(xxhash64(id, {i}), 1048576) / 1048576D - 0.5D AS x{i}" for i in range(width)]
    names = [f"{prefix}{i + 1}" for i in range(dims)]
    parts = materialize(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "parts")
    start = degree.withColumnRenamed("src", "id").join(parts, "id").selectExpr("id", "component", "sqrt(degree) AS root", *noise)
    owned = scaled.join(parts.withColumnRenamed("id", "src"), "src")
    sizes = materialize(owned.groupBy("component").agg(F.count("*").alias("links")), "sizes")
    small, large = (sizes.where(f"links {sign} {TASK_BUCKETS * BUCKET_EDGES}").select("component") for sign in ("<=", ">"))
    near = materialize(_near(start.join(small, "component", "left_semi"), owned.join(small, "component", "left_semi"), width, dims, tolerance, most_products, names), "layout")
    if large.isEmpty():
        for table in (edges, degree, parts, sizes):
            discard(spark, table)
        return _signed(near, names)
    start, owned = start.join(large, "component", "left_semi"), owned.join(large, "component", "left_semi")
    if (long := Reduced(edges.join(parts.withColumnRenamed("id", "src"), "src").join(large, "component", "left_semi"))).rounds:
        solved, rest = (start.join(long.solved, "component", how) for how in ("left_semi", "left_anti"))
        near = near.unionByName(_far(solved, owned, long, width, dims, tolerance, names))
        start, owned = rest, owned.join(long.solved, "component", "left_anti")
        if start.isEmpty():
            near = materialize(near, "layout")
            long.drop()
            for table in (edges, degree, parts, sizes):
                discard(spark, table)
            return _signed(near, names)
    scaled = owned.select("src", "dst", "w")
    tables, kept = Bucketed(edges), Bucketed(edges)
    scaled = kept.store(scaled, "dst", "scaled")
    state = tables.store(start, "id", "vectors")
    products = 0
    while True:
        xs, ys = [f"x{i}" for i in range(width)], [f"y{i}" for i in range(width)]
        moved = state.join(_pulled(scaled, state, xs, ys), "id")
        state = tables.store(moved.select("id", "component", "root", *xs, *ys), "id", "vectors")
        tables.drop(keep=1)
        products += 1
        turns = materialize(_turns(state, width, dims), "turns")
        worst = turns.agg(F.max("residual")).first()[0]
        turned = _turned(state, turns, width)
        if worst is None or worst <= tolerance or products >= most_products:
            laid = materialize(turned.select("id", "component", "residual", *[F.col(f"x{i}").alias(n) for i, n in enumerate(names)]), "layout")
            tables.drop()
            kept.drop()
            for table in (turns, edges, degree, parts, sizes):
                discard(spark, table)
            return _signed(laid.unionByName(near), names)
        # Rows of a component whose degree is reached stay as they are. The first product is known already.
        first = [f"(y{i} - centre * x{i}) / half AS z{i}" for i in range(width)]
        state = tables.store(turned.selectExpr("id", "component", "root", "centre", "half", "degree", *xs, *first), "id", "vectors")
        for step in range(2, turns.agg(F.max("degree")).first()[0] + 1):
            moved = state.join(_pulled(scaled, state, [f"z{i}" for i in range(width)], ys), "id")
            go = f"degree >= {step}"
            state = tables.store(moved.selectExpr(
                "id", "component", "root", "centre", "half", "degree", *[f"if({go}, z{i}, x{i}) AS x{i}" for i in range(width)],
                *[f"if({go}, 2D * (y{i} - centre * z{i}) / half - x{i}, z{i}) AS z{i}" for i in range(width)],
            ), "id", "vectors")
            tables.drop(keep=1)
            products += 1
        state = state.select("id", "component", "root", *[F.col(f"z{i}").alias(f"x{i}") for i in range(width)])


def _pulled(scaled: DataFrame, state: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """``A`` times the columns of each vertex."""
    sent = state.select(F.col("id").alias("dst"), *columns)
    sums = [F.expr(f"sum(w * {c})").alias(n) for c, n in zip(columns, names)]
    return scaled.join(sent, "dst").groupBy(F.col("src").alias("id")).agg(*sums)


def _turns(state: DataFrame, width: int, dims: int) -> DataFrame:
    """Per component the combinations that are best, how good they are, and the next polynomial.

    ``(component, off, turn, residual, centre, half, degree)``, from the inner products of the trivial vector, the vectors and
    their products. Tasks add up one small matrix for each component they meet.
    """
    columns = ["root", *[f"x{i}" for i in range(width)], *[f"y{i}" for i in range(width)]]
    kind = state.schema["component"].dataType.simpleString()

    cells = _grams(state, columns)
    schema = f"component {kind}, off array<double>, turn array<double>, residual double, centre double, half double, degree int"

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros(len(columns) ** 2)
        gram[pdf["at"].to_numpy()] = pdf["v"].to_numpy()
        off, turn, residual, least, top, _ = ritz(gram.reshape(len(columns), -1), width, dims)
        centre, half, degree = polynomial(least, top)
        return pd.DataFrame({
            "component": [pdf["component"].iloc[0]], "off": [off.tolist()], "turn": [turn.ravel().tolist()], "residual": [residual],
            "centre": [centre], "half": [half], "degree": [degree],
        })

    return cells.groupBy("component").applyInPandas(best, schema)


def _grams(state: DataFrame, columns: list[str]) -> DataFrame:
    """``(component, at, v)``: inner products of the columns, cell by cell."""
    kind = state.schema["component"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            z = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            grams = [(z[order[a:b]].T @ z[order[a:b]]).ravel() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array([g.tolist() for g in grams], pa.list_(pa.float64()))], names=["component", "gram"])

    parts = state.select("component", *columns).mapInArrow(partial, f"component {kind}, gram array<double>")
    return parts.select("component", F.posexplode("gram").alias("at", "v")).groupBy("component", "at").agg(F.sum("v").alias("v"))


def polynomial(least: float, top: float) -> tuple[float, float, int]:
    """Centre, half width and degree of the next Chebyshev polynomial, from the least and the greatest value of a block."""
    apart = math.acosh(1.0 + 2.0 * max(top - least, 1e-12) / (1.0 + least))
    # What rounding leaves of the trivial vector grows faster than the rest, and must stay small as well.
    trivial = math.acosh(1.0 + 2.0 * (1.0 - least) / (1.0 + least))
    degree = int(np.clip(min(math.log(GROWTH) / apart, math.log(1e12) / max(trivial, 1e-6)), 1, CYCLE))
    return (least - 1.0) / 2.0, (1.0 + least) / 2.0, degree


def _near(vertices: DataFrame, links: DataFrame, width: int, dims: int, tolerance: float, most: int, names: list[str]) -> DataFrame:
    """``(id, component, residual, <names>)`` of components whose edges fit a task: the cycles of :func:`spectral_embedding` on arrays."""

    def lay(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        ids = pd.Index(own["id"])
        src, dst = ids.get_indexer(edges["src"]), ids.get_indexer(edges["dst"])
        order = np.lexsort((dst, src))
        w, src, dst = edges["w"].to_numpy()[order, None], src[order], dst[order]
        # Every vertex has an edge.
        starts = np.searchsorted(src, np.arange(len(own)))
        root, x = own["root"].to_numpy()[:, None], own[[f"x{i}" for i in range(width)]].to_numpy()
        solver = Elimination(src, dst, w[:, 0] * root[src, 0] * root[dst, 0], len(own)) if len(own) > CORE else None
        if solver is not None and solver.whole:
            # D^1/2 L^-1 D^1/2 is the inverse of 1 - A.
            x, residual = smoothest(solver, lambda x: np.add.reduceat(w * x[dst], starts, axis=0), root, x, dims, tolerance)
            return pd.DataFrame({"id": own["id"], "component": own["component"], "residual": residual, **dict(zip(names, x.T))})
        products = 0
        while True:
            y = np.add.reduceat(w * x[dst], starts, axis=0)
            products += 1
            z = np.hstack([root, x, y])
            off, turn, residual, least, top, gap = ritz(z.T @ z, width, dims)
            x, y = (x - root * off) @ turn, (y - root * off) @ turn
            if residual <= min(tolerance, NEAR * gap) or products >= most:
                coordinates = dict(zip(names, x.T))
                return pd.DataFrame({"id": own["id"], "component": own["component"], "residual": residual, **coordinates})
            centre, half, degree = polynomial(least, top)
            z = (y - centre * x) / half
            for _ in range(2, degree + 1):
                x, z = z, 2.0 * (np.add.reduceat(w * z[dst], starts, axis=0) - centre * z) / half - x
                products += 1
            x = z

    fields = {f.name: f.dataType.simpleString() for f in vertices.schema.fields}
    schema = f"id {fields['id']}, component {fields['component']}, residual double, " + ", ".join(f"{n} double" for n in names)
    # Both sides come from one table: new names keep their columns apart.
    return vertices.groupBy("component").cogroup(links.selectExpr("component AS of", "src", "dst", "w").groupBy("of")).applyInPandas(lay, schema)


class Elimination:
    """Exact solutions of ``L u = b``, ``L`` being a connected graph's Laplacian, by elimination in rounds.

    A round takes out vertices with one or two neighbours, no two of them neighbours, and links the two by an edge that stands for the way through;
    some third of a path goes, so that rounds grow with the logarithm of its length. At most ``CORE`` vertices that are left are solved for as a
    dense matrix; ``whole`` is false if more stay, all well linked. Takes each edge in both directions, ordered by ``src`` and ``dst``.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int):
        self.rounds: list[tuple[np.ndarray, ...]] = []
        src, dst, w = _merged(src, dst, w, n)
        left, rng = np.arange(n), np.random.default_rng(1)
        while len(left) > CORE and w.all():
            starts = np.searchsorted(src, left)
            links = np.diff(starts, append=len(src))
            # The greatest lot among its neighbours that may go: a lot of 0 stays.
            lot = np.zeros(n)
            lot[left] = np.where(links <= 2, 1.0 + rng.random(len(left)), 0.0)
            go = (lot[left] > 0) & (lot[left] > np.maximum.reduceat(lot[dst], starts))
            if go.sum() < len(left) // 100:
                break
            at, two = starts[go], links[go] == 2
            gone, a, b = left[go], dst[at], dst[at + two]
            wa, wb = w[at], np.where(two, w[at + two], 0.0)
            whole = wa + wb
            # What each gives to its neighbours, by neighbour.
            to, of, share = np.concatenate([a, b[two]]), np.concatenate([gone, gone[two]]), np.concatenate([wa / whole, (wb / whole)[two]])
            order = np.argsort(to, kind="stable")
            to, of, share = to[order], of[order], share[order]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            self.rounds.append((gone, a, b, (wa / whole)[:, None], (wb / whole)[:, None], whole[:, None], to[first], first, of, share[:, None]))
            stay = np.ones(n, dtype=bool)
            stay[gone] = False
            kept, through = stay[src] & stay[dst], (wa / whole * wb)[two]
            a, b = a[two], b[two]
            src, dst, w = _merged(np.concatenate([src[kept], a, b]), np.concatenate([dst[kept], b, a]), np.concatenate([w[kept], through, through]), n)
            left = left[~go]
        # A product of weights may be too small for a number.
        self.left, self.whole = left, len(left) <= CORE and bool(w.all())
        if self.whole and len(left) > 1:
            core = np.zeros((len(left), len(left)))
            core[np.searchsorted(left, src), np.searchsorted(left, dst)] = -w
            np.fill_diagonal(core, -core.sum(axis=1))
            try:
                self.inverse = np.linalg.inv(core[1:, 1:])  # the first of them is held at 0
            except np.linalg.LinAlgError:
                self.whole = False

    def solve(self, b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for *_, to, first, of, share in self.rounds:
            b[to] += np.add.reduceat(share * b[of], first, axis=0)
        u = np.zeros_like(b)
        if len(self.left) > 1:
            u[self.left[1:]] = self.inverse @ b[self.left[1:]]
        for gone, one, two, share_one, share_two, whole, *_ in reversed(self.rounds):
            u[gone] = b[gone] / whole + share_one * u[one] + share_two * u[two]
        return u


def _merged(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in order, parallel ones as one."""
    key = src * n + dst
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // n, key[first] % n, np.add.reduceat(w[order], first)


def smoothest(
    solver: Elimination, product: Callable[[np.ndarray], np.ndarray], root: np.ndarray, x: np.ndarray, dims: int, tolerance: float
) -> tuple[np.ndarray, float]:
    """The ``dims`` leading eigenvectors of the normalised adjacency ``A`` after ``root``, from a block of vectors to begin with, and their residual.

    The block goes through the inverse of ``1 - A`` again and again, in which the wanted vectors grow beside the rest by the ratio of their
    distances from 1, however small these are, until residuals are small beside the distance of the inverse's values, and at most ``tolerance`` in ``A``.
    """
    root = root / np.linalg.norm(root)
    # All but a few vectors stays in place, by portions of rows.
    rows = np.array_split(np.arange(len(x)), -(-len(x) // 65_536))
    portions = [slice(int(r[0]), int(r[-1]) + 1) for r in rows]

    def upright(x: np.ndarray) -> np.ndarray:
        """At right angles to ``root`` and each other, of length 1."""
        for _ in range(2):
            share, parts = root.T @ x, []
            for p in portions:
                x[p], part = np.linalg.qr(x[p] - root[p] * share)
                parts.append(part)
            turns = np.split(np.linalg.qr(np.vstack(parts))[0], len(portions))
            for p, turn in zip(portions, turns):
                x[p] = x[p] @ turn
        return x

    x, y = upright(x.copy()), np.empty_like(x)
    for _ in range(MOST_SOLVES):
        for at in range(0, x.shape[1], AT_ONCE):
            few = root * solver.solve(root * x[:, at : at + AT_ONCE])
            y[:, at : at + AT_ONCE] = few - root * (root.T @ few)
        h = x.T @ y
        values, mixed = np.linalg.eigh((h + h.T) / 2)
        values, mixed = values[::-1], mixed[:, ::-1]
        best = x @ mixed[:, :dims]
        inverse = np.linalg.norm(y @ mixed[:, :dims] - best * values[:dims], axis=0).max()
        moved = product(best)
        residual = float(np.linalg.norm(moved - best * (best * moved).sum(axis=0), axis=0).max())
        steps = -np.diff(values[: dims + 1])
        if residual <= tolerance and inverse <= NEAR * steps[steps > EQUAL * values[0]].min(initial=values[0]):
            break
        for p in portions:
            y[p] = y[p] @ mixed
        x, y = upright(y), x
    return best, residual


class Reduced:
    """Components too large for a task, brought down by the rounds of :class:`Elimination`, each a few joins, until their edges fit one.

    ``rounds`` holds ``(component, id, a, b, share_a, share_b, whole)`` of the vertices of a round, ``core`` the edges between those left, ``solved`` the
    components whose core the task that holds it reduces further to its end.
    """

    def __init__(self, edges: DataFrame):
        self.spark, self.rounds, limit = edges.sparkSession, [], TASK_BUCKETS * BUCKET_EDGES
        kind = edges.schema["component"].dataType.simpleString()
        found = edges.select("component").distinct()
        self.core = materialize(edges.groupBy("component", "src", "dst").agg(F.sum("weight").alias("w")), "core")
        while True:
            if (self.core.groupBy("component").count().agg(F.max("count")).first()[0] or 0) <= limit:
                break
            ends = self.core.groupBy("component", F.col("src").alias("id")).agg(
                F.count("*").alias("links"), F.min("dst").alias("a"), F.max("dst").alias("b"), F.expr("min_by(w, dst)").alias("wa"), F.expr("max_by(w, dst)").alias("wb"),
            ).where("links <= 2").withColumn("lot", F.xxhash64("id", F.lit(len(self.rounds))))
            ends, before = materialize(ends, "ends"), self.core.count()
            if ends.count() * 100 < before:
                discard(self.spark, ends)
                break
            lots = ends.select("id", "lot")
            met = ends.join(lots.toDF("a", "lot_a"), "a", "left").join(lots.toDF("b", "lot_b"), "b", "left")
            met = met.where("coalesce(lot > lot_a, true) AND coalesce(lot > lot_b, true)")
            gone = materialize(met.selectExpr(
                "component", "id", "a", "b", "if(links = 2, wa / (wa + wb), 1D) AS share_a", "if(links = 2, wb / (wa + wb), 0D) AS share_b",
                "if(links = 2, wa + wb, wa) AS whole",
            ), "gone")
            discard(self.spark, ends)
            through = gone.where("a <> b").selectExpr("component", "a AS src", "b AS dst", "share_a * share_b * whole AS w")
            ids = gone.select("id")
            left = self.core.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti").select("component", "src", "dst", "w")
            fresh = left.unionAll(through).unionAll(through.select("component", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
            fresh = materialize(fresh.groupBy("component", "src", "dst").agg(F.sum("w").alias("w")), "core")
            self.rounds.append(gone)
            discard(self.spark, self.core)
            self.core = fresh
            if fresh.count() > 0.99 * before or not through.where("NOT w > 0").isEmpty():
                break

        def ends_well(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"component": pdf["component"].iloc[:1], "fits": [_core_solver(pdf).whole]})

        sizes = self.core.groupBy("component").agg(F.count("*").alias("n"))
        small = sizes.where(f"n <= {limit}").select("component")
        left = self.core.join(small, "component", "left_semi").groupBy("component").applyInPandas(ends_well, f"component {kind}, fits boolean")
        unfit = sizes.where(f"n > {limit}").select("component").unionAll(left.where("NOT fits").select("component"))
        self.solved = materialize(found.join(unfit, "component", "left_anti"), "solved")
        if self.solved.isEmpty():
            self.drop()

    def drop(self) -> None:
        for table in (*self.rounds, self.core, self.solved):
            discard(self.spark, table)
        self.rounds = []

    def solve(self, b: DataFrame, width: int) -> DataFrame:
        """``(id, component, v0 ..)``: solutions for the right sides in the same columns."""
        vs = [f"v{i}" for i in range(width)]
        kinds = {f.name: f.dataType.simpleString() for f in b.schema.fields}
        levels = [materialize(b, "down")]
        for gone in self.rounds:
            mine = levels[-1].join(gone.drop("component"), "id")
            given = [mine.select(F.col(n).alias("id"), "component", *[(F.col(f"share_{n}") * F.col(v)).alias(v) for v in vs]) for n in ("a", "b")]
            stay = levels[-1].join(gone.select("id"), "id", "left_anti")
            levels.append(materialize(stay.unionByName(given[0]).unionByName(given[1]).groupBy("id", "component").agg(*[F.sum(v).alias(v) for v in vs]), "down"))

        def solved(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            out = own.sort_values("id")
            if len(out) > 1:
                solver = _core_solver(links)
                out[vs] = solver.solve(out[vs].to_numpy())
            else:
                out[vs] = 0.0
            return out

        links = self.core.selectExpr("component AS of", "src", "dst", "w").groupBy("of")
        schema = ", ".join(f"{n} {kinds[n]}" for n in ("id", "component", *vs))
        u = materialize(levels[-1].select("id", "component", *vs).groupBy("component").cogroup(links).applyInPandas(solved, schema), "up")
        for gone, level in zip(reversed(self.rounds), reversed(levels[:-1])):
            mine = gone.drop("component").join(level, "id")
            for n in ("a", "b"):
                mine = mine.join(u.select(F.col("id").alias(n), *[F.col(v).alias(f"{n}_{v}") for v in vs]), n)
            new = mine.select("id", "component", *[F.expr(f"{v} / whole + share_a * a_{v} + share_b * b_{v}").alias(v) for v in vs])
            fresh = materialize(u.unionByName(new), "up")
            discard(self.spark, u)
            u = fresh
        for level in levels:
            discard(self.spark, level)
        return u


def _core_solver(links: pd.DataFrame) -> Elimination:
    ids = pd.Index(np.unique(links["src"]))
    src, dst = ids.get_indexer(links["src"]), ids.get_indexer(links["dst"])
    return Elimination(src, dst, links["w"].to_numpy(), len(ids))


def _far(vertices: DataFrame, links: DataFrame, long: Reduced, width: int, dims: int, tolerance: float, names: list[str]) -> DataFrame:
    """``(id, component, residual, <names>)`` of components that :class:`Reduced` solves for: the iteration of :func:`smoothest`, a solution some jobs."""
    spark, xs, ys, vs = vertices.sparkSession, *([f"{c}{i}" for i in range(width)] for c in "xyv")
    kind = vertices.schema["component"].dataType.simpleString()
    links = links.select("src", "dst", "w")

    def upright(df: DataFrame, columns: list[str]) -> DataFrame:
        shares = df.groupBy("component").agg(*[F.expr(f"sum(root * {c}) / sum(root * root)").alias(f"off_{c}") for c in columns])
        return df.join(shares, "component").selectExpr(*[c for c in df.columns if c not in columns], *[f"{c} - root * off_{c} AS {c}" for c in columns])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        size = 2 * width
        gram = np.zeros(size * size)
        gram[pdf["at"].to_numpy()] = pdf["v"].to_numpy()
        gram = gram.reshape(size, size)
        g, h, k = gram[:width, :width], gram[:width, width:], gram[width:, width:]
        h, scale = (h + h.T) / 2, np.sqrt(np.maximum(np.diag(g), 1e-300))
        values, vectors = np.linalg.eigh(g / scale[:, None] / scale)
        sound = values > values[-1] * 1e-12
        base = vectors[:, sound] / np.sqrt(values[sound]) / scale[:, None]
        found, mixed = np.linalg.eigh(base.T @ h @ base)
        found, weights = found[::-1], (base @ mixed)[:, ::-1]
        gaps = [max(w @ (k - 2 * t * h + t * t * g) @ w, 0.0) ** 0.5 for w, t in zip(weights.T[:dims], found)]
        steps = -np.diff(found[: dims + 1])
        turn, onward = np.zeros((2, width, width))
        turn[:, : weights.shape[1]] = weights
        onward[:, : weights.shape[1]] = weights / np.maximum(found, found[0] * 1e-15)
        # Sums of squares tell residuals from rounding down to the root of a double's.
        done = max(gaps) <= max(NEAR * steps[steps > EQUAL * found[0]].min(initial=found[0]), 1e-7 * found[0])
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "turn": [turn.ravel().tolist()], "onward": [onward.ravel().tolist()], "done": [bool(done)]})

    state = materialize(upright(vertices.select("id", "component", "root", *xs), xs), "vectors")
    for step in range(1, MOST_SOLVES + 1):
        u = long.solve(state.select("id", "component", *[(F.col("root") * F.col(x)).alias(v) for x, v in zip(xs, vs)]), width)
        met = state.join(u.drop("component"), "id").selectExpr("id", "component", "root", *xs, *[f"root * {v} AS {y}" for v, y in zip(vs, ys)])
        both = materialize(upright(met, ys), "vectors")
        schema = f"component {kind}, turn array<double>, onward array<double>, done boolean"
        turns = materialize(_grams(both, [*xs, *ys]).groupBy("component").applyInPandas(best, schema), "turns")
        for table in (state, u):
            discard(spark, table)

        def mixed(of: list[str], by: str, to: list[str]) -> list[str]:
            return [" + ".join(f"{c} * {by}[{i * width + j}]" for i, c in enumerate(of)) + f" AS {n}" for j, n in enumerate(to)]

        turned = both.join(turns, "component")
        if turns.where("NOT done").isEmpty() or step == MOST_SOLVES:
            laid = materialize(turned.selectExpr("id", "component", *mixed(xs, "turn", names)), "layout")
            moved = links.join(laid.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.expr(f"sum(w * {n})").alias(f"to_{n}") for n in names])
            met = materialize(laid.join(moved, "id"), "layout")
            value = met.groupBy("component").agg(*[F.expr(f"sum({n} * to_{n})").alias(f"value_{n}") for n in names])
            off = met.join(value, "component").groupBy("component").agg(F.greatest(*[F.expr(f"sqrt(sum(pow(to_{n} - value_{n} * {n}, 2D)))") for n in names], F.lit(0.0)).alias("residual"))
            off = materialize(off, "turns")
            discard(spark, met)
            if step == MOST_SOLVES or off.where(f"residual > {tolerance!r}").isEmpty():
                out = materialize(laid.join(off, "component").select("id", "component", "residual", *names), "layout")
                for table in (laid, off, both, turns):
                    discard(spark, table)
                return out
            for table in (laid, off):
                discard(spark, table)
        state = materialize(turned.selectExpr("id", "component", "root", *mixed(ys, "onward", xs)), "vectors")
        for table in (both, turns):
            discard(spark, table)


def ritz(gram: np.ndarray, width: int, dims: int) -> tuple[np.ndarray, np.ndarray, float, float, float, float]:
    """Best combinations of vectors ``X`` from the inner products of ``root | X | AX``.

    Returns the share of ``root`` in each vector, which is taken off first (``A`` leaves ``root`` as it is), the weights of the
    combinations in order of falling value (zeros where there are none), the greatest residual of the first ``dims``, the least and greatest value,
    and how far the first ``dims`` values lie from each other and the next, but for those that are equal.
    """
    x, y = slice(1, width + 1), slice(width + 1, None)
    off = gram[0, x] / gram[0, 0]
    taken = gram[0, 0] * np.outer(off, off)
    g, h, k = gram[x, x] - taken, gram[x, y] - taken, gram[y, y] - taken
    h = (h + h.T) / 2
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    values, vectors = np.linalg.eigh(g / scale[:, None] / scale)
    sound = values > max(values[-1] * 1e-12, 1e-13)
    if not sound.any() or np.diag(g).max() <= 1e-18 * gram[0, 0]:
        return off, np.zeros((width, width)), 0.0, 0.0, 1.0, 1.0
    base = vectors[:, sound] / np.sqrt(values[sound]) / scale[:, None]
    found, mixed = np.linalg.eigh(base.T @ h @ base)
    weights = (base @ mixed)[:, ::-1]
    found = np.clip(found[::-1], -1.0, 1.0)
    wanted = min(dims, len(found))
    gaps = [max(w @ (k - 2 * t * h + t * t * g) @ w, 0.0) ** 0.5 for w, t in zip(weights.T[:wanted], found)]
    turn = np.zeros((width, width))
    turn[:, : weights.shape[1]] = weights
    steps = -np.diff(found[: dims + 1])
    return off, turn, max(gaps), float(max(found[-1], -0.99)), float(found[0]), float(steps[steps > EQUAL].min(initial=1.0))


def _turned(state: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """The best combinations of the vectors and of their products, with the component's further columns."""
    met = state.join(turns, "component")
    columns = [f"x{i}" for i in range(width)] + [f"y{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            coded = batch.column(at["component"]).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            root = batch.column(at["root"]).to_numpy(zero_copy_only=False)
            z = np.column_stack([batch.column(at[c]).to_numpy(zero_copy_only=False) for c in columns])
            for code in range(len(coded.dictionary)):
                own = np.flatnonzero(codes == code)
                off = np.array(batch.column(at["off"])[int(own[0])].as_py())
                turn = np.array(batch.column(at["turn"])[int(own[0])].as_py()).reshape(width, width)
                for half in (slice(0, width), slice(width, None)):
                    z[own, half] = (z[own, half] - root[own, None] * off) @ turn
            rest = [n for n in batch.schema.names if n not in (*columns, "off", "turn")]
            yield pa.RecordBatch.from_arrays([*[batch.column(at[n]) for n in rest], *[pa.array(c) for c in z.T]], names=[*rest, *columns])

    rest = [f for f in met.schema.fields if f.name not in (*columns, "off", "turn")]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rest], *[f"{c} double" for c in columns]])
    return met.mapInArrow(run, schema)


def _signed(laid: DataFrame, columns: list[str]) -> DataFrame:
    """Make the largest coordinate of each column and component positive."""
    tops = laid.groupBy("component").agg(*[F.max_by(F.signum(c), F.struct(F.abs(c), F.col("id"))).alias(f"sign_{c}") for c in columns])
    signs = [(F.col(c) * F.when(F.col(f"sign_{c}") < 0, -1.0).otherwise(1.0)).alias(c) for c in columns]
    return laid.join(tops, "component").select("id", "component", "residual", *signs)


# --- clusters ------------------------------------------------------------------------


def graph_cluster(graph: DataFrame, k: int = 2, change: float = 1e-5, most_products: int = 500) -> DataFrame:
    """``(id, cluster)`` with labels ``0..k-1``, by truncated power iteration on the weighted graph.

    A vector that begins with a hash of each id is averaged over the neighbours again and again, which evens it out quickly
    within dense parts and slowly between them. It stops where the change from step to step itself changes by at most ``change``
    times the mean value, so that parts are even and not yet alike. The values are then cut into ``k`` ranges with the least
    sum of squares, exactly on ``BINS`` equal steps between the least and the greatest value; labels follow the values. The start depends on ids alone
    and sums are in double precision, so labels do not depend on how rows are partitioned, but for values within rounding of a
    cut. Fewer labels come out if there are fewer different values.
    """
    edges = materialize(both_ways(graph), "edges")
    kept = Bucketed(edges)
    degree = materialize(edges.groupBy("src").agg(F.sum("weight").alias("degree")), "degree")
    if degree.isEmpty():
        return degree.select(F.col("src").alias("id"), F.lit(0).alias("cluster"))
    # A loop without weight, which edges never are, hands each vertex its last values along with the sum.
    loops = degree.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("w"))
    scaled = edges.join(degree, "src").select("src", "dst", (F.col("weight") / F.col("degree")).alias("w")).unionAll(loops)
    scaled = kept.store(scaled, "dst", "scaled")
    # Averages keep the range of the start, values between 0 and 1; their sum is about n / 2 throughout.
    values = materialize(degree.selectExpr("src AS id", "pmod(xxhash64(src), 1048576) / 1048576D AS v"), "values")
    for done in range(0, most_products, LOOK):
        steps = min(LOOK, most_products - done)
        moved = values.select("id", "v")
        for step in range(steps):
            moved = _averaged(scaled, moved, keep=steps - step <= 2)
        fresh = materialize(moved, "values")
        discard(values.sparkSession, values)
        values = fresh
        if steps == LOOK and values.agg(F.max(F.abs(F.abs(F.col("v") - F.col("last")) - F.abs(F.col("last") - F.col("older"))))).first()[0] <= change / 2:
            break
    kept.drop()
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if high <= low:
        return values.select("id", F.lit(0).alias("cluster"))
    at = F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int")
    bins = values.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("at").collect()
    cuts = [bins[i]["at"] for i in least_squares_cuts(np.array([(b["s"] / b["n"] - low) / (high - low) for b in bins]), np.array([b["n"] for b in bins], float), k)]
    label = sum((F.when(at >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return values.select("id", label.cast("int").alias("cluster"))


def _averaged(scaled: DataFrame, state: DataFrame, keep: bool) -> DataFrame:
    """``(id, v)``: each vertex's average over its neighbours, and to ``keep`` them its value before as ``last`` and that one's ``last`` as ``older``."""
    own = [F.max(F.when(F.col("src") == F.col("dst"), F.col(c))).alias(n) for c, n in (("v", "last"), ("last", "older")) if keep and c in state.columns]
    return scaled.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"), *own)


def least_squares_cuts(x: np.ndarray, weight: np.ndarray, k: int) -> list[int]:
    """Where to cut ascending weighted values into at most ``k`` ranges with the least sum of squares about their means."""
    n, k = len(x), min(k, len(x))
    w, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weight, weight * x, weight * x * x))

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        """Of the range ``a .. b - 1``, for all ``a``."""
        return q[b] - q[a] - (s[b] - s[a]) ** 2 / (w[b] - w[a])

    best = np.array([0.0, *[cost(np.array([0]), b)[0] for b in range(1, n + 1)]])
    back = []
    for parts in range(2, k + 1):
        fresh, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for b in range(parts, n + 1):
            a = np.arange(parts - 1, b)
            total = best[a] + cost(a, b)
            cut[b] = a[total.argmin()]
            fresh[b] = total.min()
        best = fresh
        back.append(cut)
    cuts, b = [], n
    for cut in reversed(back):
        b = int(cut[b])
        cuts.append(b)
    return cuts[::-1]
