"""Components, layouts and clusters of graphs against direct computation."""

import itertools

import numpy as np
import pytest
from test_vectors import same_partition

from cohortlens.operators import graph as gr

CLIQUES = [(a + o, b + o, 1.0) for o in (0, 4) for a in range(4) for b in range(a + 1, 4)] + [(0, 4, 0.01)]
RING = [(6 * c + a, 6 * c + b, 1.0) for c in range(8) for a, b in itertools.combinations(range(6), 2)] + [(6 * c, 6 * (c + 1) % 48 + 1, 0.3) for c in range(8)]
PATH = [(i, i + 1, 1.0) for i in range(39)]
TWO = PATH[:20] + [(1000 + a, 1000 + b, w) for a, b, w in RING] + [(5000, 5001, 2.0)]


def frame(spark, edges, parts=4):
    return spark.createDataFrame(edges, "src long, dst long, weight double").repartition(parts)


def normalised(edges):
    ids = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for a, b, v in edges:
        w[at[a], at[b]] += v
        w[at[b], at[a]] += v
    d = w.sum(axis=1)
    return ids, w / np.sqrt(d[:, None] * d[None, :])


def parts_of(edges):
    root = {x: x for e in edges for x in e[:2]}
    for _ in root:
        for a, b, _w in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("edges", [PATH, RING, TWO, CLIQUES], ids=["path", "ring", "several", "cliques"])
def test_spectral_embedding_converges(spark, edges):
    rows = {r.id: r for r in gr.spectral_embedding(frame(spark, edges), tolerance=1e-4).collect()}
    root = parts_of(edges)
    assert {i: r.component for i, r in rows.items()} == root
    for part in set(root.values()):
        own = [e for e in edges if root[e[0]] == part]
        ids, a = normalised(own)
        values, vectors = np.linalg.eigh(a)
        values, vectors = values[::-1], vectors[:, ::-1]
        for k in (1, 2):
            x = np.array([rows[i][f"Embedding_{k}"] for i in ids])
            if k >= len(ids):
                assert not x.any()
                continue
            assert np.linalg.norm(x) == pytest.approx(1) and x[np.abs(x).argmax()] > 0
            residual = np.linalg.norm(a @ x - (x @ a @ x) * x)
            assert residual <= 1e-4 and residual <= rows[ids[0]].residual * 1.01 + 1e-7
            alike = np.abs(values - values[k]) < 1e-3  # eigenvectors of values this close mix at this tolerance
            assert np.linalg.norm(vectors[:, alike].T @ x) > 0.99
            assert x @ a @ x == pytest.approx(values[k], abs=1e-5)


def test_layout_does_not_depend_on_partitions(spark, monkeypatch):
    laid = []
    for parts, edges in ((1, 1000), (7, 5)):  # in one bucket, and in several
        monkeypatch.setattr(gr, "BUCKET_EDGES", edges)
        laid.append({r.id: abs(r.Embedding_1) for r in gr.spectral_embedding(frame(spark, CLIQUES, parts)).collect()})
    assert all(laid[0][i] == pytest.approx(laid[1][i], abs=1e-7) for i in laid[0])  # the second value is a multiple one, and the graph is symmetric, which leaves the sign open


def test_empty_graph(spark):
    nothing = frame(spark, [(1, 1, 1.0), (2, 3, 0.0)])
    assert gr.spectral_embedding(nothing).count() == 0 and gr.graph_cluster(nothing).count() == 0


def groups(seed=3, n=60):
    rng = np.random.default_rng(seed)
    edges = {}
    for o in range(3):
        for _ in range(8 * n):
            a, b = rng.integers(0, n, 2)
            if a != b:
                edges[min(a, b) + n * o, max(a, b) + n * o] = 1.0
    edges[0, n] = edges[n + 1, 2 * n] = 0.05
    return [(int(a), int(b), w) for (a, b), w in edges.items()]


def test_graph_cluster(spark):
    rows = gr.graph_cluster(frame(spark, CLIQUES), k=2).orderBy("id").collect()
    assert same_partition([r.cluster for r in rows], np.repeat([0, 1], 4))
    found = [[r.cluster for r in gr.graph_cluster(frame(spark, groups(), n), k=3).orderBy("id").collect()] for n in (1, 7, 31)]
    assert found[0] == found[1] == found[2] and same_partition(found[0], np.repeat([0, 1, 2], 60))


def test_graph_without_structure_has_the_same_labels_on_any_partitioning(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 150, 700), rng.integers(0, 150, 700), rng.random(700)) if a != b]
    found = [[tuple(r) for r in gr.graph_cluster(frame(spark, edges, n), k=2).orderBy("id").collect()] for n in (1, 7, 31)]
    assert found[0] == found[1] == found[2]


def test_least_squares_cuts():
    rng = np.random.default_rng(5)
    x, w = np.sort(rng.random(9)), rng.integers(1, 5, 9).astype(float)

    def loss(cuts):
        parts = np.split(np.arange(9), list(cuts))
        return sum((w[p] * (x[p] - np.average(x[p], weights=w[p])) ** 2).sum() for p in parts)

    for k in (1, 2, 3, 4):
        assert loss(gr.least_squares_cuts(x, w, k)) == pytest.approx(min(map(loss, itertools.combinations(range(1, 9), k - 1))))


def test_long_path_is_laid_out_in_the_task_that_holds_it(spark, monkeypatch):
    # Close values: only a residual far below their distance tells the two vectors apart.
    n = 1500
    path = [(i, i + 1, 1.0) for i in range(n - 1)]
    monkeypatch.setattr(gr, "Bucketed", None)  # no product is a job of its own
    rows = gr.spectral_embedding(frame(spark, path), tolerance=1e-4).orderBy("id").collect()
    place = np.arange(n)
    root = np.where((place == 0) | (place == n - 1), 1.0, np.sqrt(2.0))
    for k in (1, 2):
        known = root * np.cos(np.pi * k * place / (n - 1))
        found = np.array([r[f"Embedding_{k}"] for r in rows])
        assert abs(found @ known) / np.linalg.norm(found) / np.linalg.norm(known) > 0.99999


def test_products_of_a_clustering_are_stored_once_per_look(spark, monkeypatch):
    cliques = [(a + 10 * c, b + 10 * c, 1.0) for c in (0, 1) for a in range(5) for b in range(a)]
    edges = spark.createDataFrame([*cliques, (0, 10, 0.01)], "src long, dst long, weight double")
    stored, store = [], gr.Bucketed.store
    monkeypatch.setattr(gr.Bucketed, "store", lambda self, df, key, label: stored.append(label) or store(self, df, key, label))
    found = {r["id"]: r["cluster"] for r in gr.graph_cluster(edges).collect()}
    assert stored == ["scaled"]
    assert len({found[i] for i in range(5)}) == len({found[10 + i] for i in range(5)}) == 1 and found[0] != found[10]


def test_averages_keep_the_values_before(spark):
    w = [(1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0), (3, 1, 1.0), (1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    scaled = spark.createDataFrame(w, "src long, dst long, w double")
    state = spark.createDataFrame([(1, 0.25), (2, 0.5), (3, 1.0)], "id long, v double")
    once = gr._averaged(scaled, state, keep=False)
    assert {tuple(r) for r in once.collect()} == {(1, 0.75), (2, 0.25), (3, 0.25)}
    twice = gr._averaged(scaled, once, keep=True)
    assert {tuple(r) for r in twice.collect()} == {(1, 0.25, 0.75), (2, 0.75, 0.25), (3, 0.75, 0.25)}
    thrice = gr._averaged(scaled, twice, keep=True)
    assert {(r["id"], r["v"], r["last"], r["older"]) for r in thrice.collect()} == {(1, 0.75, 0.25, 0.75), (2, 0.25, 0.75, 0.25), (3, 0.25, 0.75, 0.25)}


def both_ways(n, edges):
    src, dst, w = (np.array(x) for x in zip(*edges, *[(b, a, v) for a, b, v in edges]))
    order = np.lexsort((dst, src))
    laplacian = np.zeros((n, n))
    np.add.at(laplacian, (src, dst), -w)
    np.fill_diagonal(laplacian, -laplacian.sum(axis=1))
    return src[order], dst[order], w[order], laplacian


@pytest.mark.parametrize("kind", ["path", "cycle", "star", "tree", "chords", "doubled"])
def test_elimination_solves_exactly(monkeypatch, kind):
    rng = np.random.default_rng(7)
    n, ends = 700, {"path": [(i, i + 1) for i in range(699)], "star": [(300, i) for i in range(700) if i != 300]}
    ends["cycle"] = [*ends["path"], (699, 0)]
    ends["tree"] = [(i, int(rng.integers(0, i))) for i in range(1, n)]
    ends["chords"] = [*ends["path"], *[(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2)) if a != b]]
    ends["doubled"] = ends["path"] * 2
    src, dst, w, laplacian = both_ways(n, [(a, b, float(v)) for (a, b), v in zip(ends[kind], rng.random(2000) + 0.1)])
    monkeypatch.setattr(gr, "CORE", 80 if kind == "chords" else 1 + (kind == "cycle"))
    solver = gr.Elimination(src, dst, w, n)
    assert solver.whole and len(solver.left) <= 80
    b = rng.normal(size=(n, 3))
    b -= b.mean(axis=0)
    assert np.allclose(laplacian @ solver.solve(b), b, atol=1e-8)


def test_well_linked_vertices_are_left():
    n = 400
    src, dst, w, _ = both_ways(n, [(i, (i + d) % n, 1.0) for i in range(n) for d in (1, 2)])
    assert not gr.Elimination(src, dst, w, n).whole


def test_a_path_longer_than_the_products_allowed_is_laid_out(spark):
    n = 20_000
    ends = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst", "1D AS weight")
    rows = gr.spectral_embedding(ends, tolerance=1e-6).orderBy("id").collect()
    place = np.arange(n)
    root = np.where((place == 0) | (place == n - 1), 1.0, np.sqrt(2.0))
    for k in (1, 2):
        known = root * np.cos(np.pi * k * place / (n - 1))
        found = np.array([r[f"Embedding_{k}"] for r in rows])
        assert abs(found @ known) / np.linalg.norm(found) / np.linalg.norm(known) > 0.999999
    assert rows[0].residual <= 1e-6


def test_trees_are_laid_out_as_by_direct_computation(spark):
    rng = np.random.default_rng(4)
    edges = [(i, int(rng.integers(max(0, i - 30), i)), float(rng.random() + 0.1)) for i in range(1, 900)]
    rows = {r.id: r for r in gr.spectral_embedding(frame(spark, edges), tolerance=1e-6).collect()}
    ids, a = normalised(edges)
    values, vectors = np.linalg.eigh(a)
    for k in (1, 2):
        x = np.array([rows[i][f"Embedding_{k}"] for i in ids])
        assert abs(x @ vectors[:, -1 - k]) > 0.99999
        assert np.linalg.norm(a @ x - (x @ a @ x) * x) <= rows[0].residual + 1e-12 <= 1e-6 + 1e-12


def test_chains_in_components_too_large_for_a_task(spark, monkeypatch):
    # A path, a star, a cycle and a tree brought down by jobs; a ring of cliques has nothing to take out and goes through the cycles.
    monkeypatch.setattr(gr, "BUCKET_EDGES", 100)
    monkeypatch.setattr(gr, "CORE", 4)
    rng = np.random.default_rng(6)
    parts = [
        [(i, i + 1, 1.0) for i in range(249)], [(1000, 1000 + i, 1.0) for i in range(1, 150)], [(2000 + i, 2000 + (i + 1) % 130, 2.0) for i in range(130)],
        [(3000 + i, 3000 + int(rng.integers(max(0, i - 9), i)), float(rng.random() + 0.1)) for i in range(1, 150)], [(9000 + a, 9000 + b, w) for a, b, w in RING],
    ]
    rows = {r.id: r for r in gr.spectral_embedding(frame(spark, sum(parts, [])), tolerance=1e-6).collect()}
    for own in parts:
        ids, a = normalised(own)
        values, vectors = np.linalg.eigh(a)
        for k in (1, 2):
            x = np.array([rows[i][f"Embedding_{k}"] for i in ids])
            assert rows[ids[0]].component == ids[0] and np.linalg.norm(x) == pytest.approx(1) and x[np.abs(x).argmax()] > 0
            assert rows[ids[0]].residual <= 1e-6 and np.linalg.norm(a @ x - (x @ a @ x) * x) <= rows[ids[0]].residual * 1.01 + 1e-7
            alike = np.abs(values - values[-1 - k]) < 1e-7
            assert np.linalg.norm(vectors[:, alike].T @ x) > 0.9999
