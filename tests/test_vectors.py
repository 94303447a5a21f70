"""Components, clusters, separation and neighbours against direct computation."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from cohortlens.operators import blocks
from cohortlens.operators import cluster as cl
from cohortlens.operators import neighbors as nb
from cohortlens.operators import reduce as rd


def frame(spark, points, extra=None):
    rows = [(i, [float(x) for x in p], *([int(extra[i])] if extra is not None else [])) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + (", cluster int" if extra is not None else ""))


def blobs(seed=0, n=40, copies=0):
    rng = np.random.default_rng(seed)
    points = np.vstack([rng.normal(c, 0.4, (n, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 6, 6))])
    return np.vstack([points, np.repeat(points[:1], copies, axis=0)]) if copies else points


def test_pca(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 6)) @ rng.normal(0, 1, (6, 6)) + 10
    rows = rd.pca(frame(spark, x), "id").orderBy("id").collect()
    got = np.array([[r.PC_1, r.PC_2, r.PC_3] for r in rows])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    top = vectors[:, ::-1][:, :3]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), range(3)])
    assert np.allclose(got, (x - x.mean(axis=0)) @ top, atol=1e-8)
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert np.all(np.diff(got.var(axis=0)) < 0)


def test_assemble(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0), (3, None, 8.0)], "id int, a double, b double")
    def run(nulls):
        return {r.id: r.vec for r in rd.assemble(df, "id", ["a", "b"], nulls).collect()}
    assert run("zero") == {1: [1, 0], 2: [3, 4], 3: [0, 8]}
    assert run("mean") == {1: [1, 6], 2: [3, 4], 3: [2, 8]}
    assert run("drop") == {2: [3, 4]}
    with pytest.raises(PySparkException, match="null in feature"):
        run("error")


def within(points, labels):
    return sum(((points[labels == c] - points[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels))


def direct_ward(points, k):
    groups = [[i] for i in range(len(points))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                ga, gb = points[groups[a]], points[groups[b]]
                cost = len(ga) * len(gb) / (len(ga) + len(gb)) * ((ga.mean(0) - gb.mean(0)) ** 2).sum()
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    labels = np.empty(len(points), dtype=int)
    for c, g in enumerate(groups):
        labels[g] = c
    return labels


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("k", [2, 3])
def test_ward_is_exact_on_few_positions(spark, k):
    points = blobs(n=15, copies=20)
    rows = cl.cluster(frame(spark, points), "id", k=k, method="ward").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(points)))
    assert same_partition([r.cluster for r in rows], direct_ward(points, k))


def test_ward_on_centres(spark):
    points = blobs(n=60)
    rows = cl.cluster(frame(spark, points), "id", k=3, method="ward_centres", micro=20).orderBy("id").collect()
    assert same_partition([r.cluster for r in rows], np.repeat([0, 1, 2], 60))


@pytest.mark.parametrize("n", [511, 513])
def test_ward_is_one_algorithm_at_every_size(spark, n):
    points = np.random.default_rng(n).random((n, 3))
    rows = cl.cluster(frame(spark, points), "id", k=2, method="ward").orderBy("id").collect()
    means, sizes, groups = points.copy(), np.ones(n), [[i] for i in range(n)]
    while len(groups) > 2:
        cost = ((means[:, None] - means[None]) ** 2).sum(axis=2) * sizes[:, None] * sizes[None] / (sizes[:, None] + sizes[None])
        np.fill_diagonal(cost, np.inf)
        a, b = sorted(np.unravel_index(cost.argmin(), cost.shape))
        means[a] = (means[a] * sizes[a] + means[b] * sizes[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        groups[a] += groups.pop(b)
        means, sizes = np.delete(means, b, axis=0), np.delete(sizes, b)
    want = np.zeros(n, dtype=int)
    want[groups[1]] = 1
    assert same_partition([r.cluster for r in rows], want)


def test_ward_on_many_positions(spark):
    points = np.vstack([np.random.default_rng(1).normal(c, 1, (1000, 3)) for c in (0, 20, 60)])
    rows = cl.cluster(frame(spark, points), "id", k=3, method="ward").orderBy("id").collect()
    assert same_partition([r.cluster for r in rows], np.repeat([0, 1, 2], 1000))
    with pytest.raises(ValueError, match="ward_centres"):
        cl.cluster(frame(spark, points), "id", k=3, method="ward", most=2999)


def test_ward_on_summaries(spark):
    points = blobs(n=15, copies=20)
    rows = cl.cluster(frame(spark, points).repartition(7), "id", k=3, method="ward_summaries").orderBy("id").collect()
    assert same_partition([r.cluster for r in rows], direct_ward(points, 3))  # few positions: exact
    points = np.vstack([np.random.default_rng(1).normal(c, 1, (1000, 3)) for c in (0, 20, 60)])
    df = frame(spark, points).repartition(20)
    rows = cl.cluster(df, "id", k=3, method="ward_summaries", micro=30).orderBy("id").collect()
    assert same_partition([r.cluster for r in rows], np.repeat([0, 1, 2], 1000))
    found = cl.summaries(df, limit=30).collect()
    assert len(found) <= 30 and sum(r.n for r in found) == 3000
    assert np.allclose(sum(np.array(r.centre) * r.n for r in found), points.sum(axis=0))
    # All squares about the mean are those between the groups and those the groups hide.
    mean = points.mean(axis=0)
    between = sum(r.n * ((np.array(r.centre) - mean) ** 2).sum() for r in found)
    assert between + sum(r.loss for r in found) == pytest.approx(((points - mean) ** 2).sum())
    assert sum(r.loss for r in found) < 0.5 * sum(((points[a : a + 1000] - points[a : a + 1000].mean(axis=0)) ** 2).sum() for a in (0, 1000, 2000))
    assert sum(r.loss for r in cl.summaries(frame(spark, points[:200]).repartition(3), limit=300).collect()) == pytest.approx(0, abs=1e-6)
    assert cl.cluster(df.limit(0), "id", k=3, method="ward_summaries").count() == 0


def test_summaries_of_tasks_without_rows(spark):
    df = frame(spark, [[0, 0], [0, 1], [9, 9]]).repartition(40)
    rows = cl.cluster(df.where("id <> 1"), "id", k=2, method="ward_summaries").orderBy("id").collect()
    assert [r.cluster for r in rows] in ([0, 1], [1, 0])
    assert sum(r.n for r in cl.summaries(df).collect()) == 3


def test_bisecting(spark):
    points = np.vstack([blobs()[:40], blobs()[40:80]])
    rows = cl.cluster(frame(spark, points), "id", k=2).orderBy("id").collect()
    assert same_partition([r.cluster for r in rows], np.repeat([0, 1], 40))


def direct_silhouette(points, labels, squared=False):
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    gaps = gaps**2 if squared else gaps
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = gaps[i, own].sum() / (own.sum() - 1)
        b = min(gaps[i, labels == o].mean() for o in set(labels) if o != c)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block", [16, 2048])
def test_silhouette(spark, block):
    points = blobs(copies=30)
    labels = np.concatenate([np.repeat([0, 1, 2], 40), np.zeros(30, dtype=int)])
    labels[5] = 1
    labels = np.append(labels, 3)
    points = np.vstack([points, [[9, 9, 9]]])
    df = frame(spark, points, labels)
    row = cl.silhouette(df, block=block, tolerance=0).first()
    assert row.error == 0 and row.silhouette == pytest.approx(direct_silhouette(points, labels)) and row.n_points == len(points)
    assert cl.silhouette(df, block=block).count() == 1  # also when no column of the result is asked for
    squared = cl.silhouette(df, metric="sqeuclidean").first().silhouette
    assert squared == pytest.approx(direct_silhouette(points, labels, squared=True))


def test_silhouette_two_pairs(spark):
    points = np.array([(0, 0), (0, 1), (5, 5), (5, 6)])
    for tolerance in (0, 1e-6):
        assert cl.silhouette(frame(spark, points, [0, 0, 1, 1]), tolerance=tolerance).first().silhouette == pytest.approx(direct_silhouette(points, np.array([0, 0, 1, 1])))


@pytest.mark.parametrize("cells", [8, 200])
@pytest.mark.parametrize("tolerance", [0.1, 0.01])
def test_silhouette_bounds(spark, cells, tolerance):
    rng = np.random.default_rng(6)
    points = np.vstack([rng.normal(c, s, (150, 3)) for c, s in (((0, 0, 0), 1), ((4, 4, 0), 2), ((0, 6, 6), 0.5))] + [np.zeros((40, 3)), [[50.0, 50.0, 50.0]]])
    labels = np.concatenate([np.repeat([0, 1, 2], 150), np.zeros(40, int), [3]])
    df = frame(spark, points, labels)
    row = cl.silhouette(df, cells=cells, tolerance=tolerance).first()
    assert row.error <= tolerance and abs(row.silhouette - direct_silhouette(points, labels)) <= row.error + 1e-12


def test_silhouette_bounds_hold_for_every_point(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(0, 1, (300, 2))
    labels = rng.integers(0, 2, 300)
    df = frame(spark, points, labels)
    found = sorted((r.n, r.cluster, r.silhouette, r.error) for r in cl.silhouette_points(df, cells=20, tolerance=0.5).collect())
    assert len(found) == 300
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    a = np.array([gaps[i, labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1) for i in range(300)])
    b = np.array([gaps[i, labels != labels[i]].mean() for i in range(300)])
    true = (b - a) / np.maximum(a, b)
    assert abs(np.mean([s for _, _, s, _ in found]) - true.mean()) <= np.mean([e for *_, e in found])
    assert min(s - e for _, _, s, e in found) <= true.min() and max(s + e for _, _, s, e in found) >= true.max()

def test_sums_by_label_keep_the_digits_of_small_distances():
    rng = np.random.default_rng(2)
    label = rng.integers(0, 7, 5000)
    points = rng.normal(0, 1e-4, (5000, 3)) + 1000.0 * label[:, None]
    weight = rng.integers(1, 5, 5000).astype(float)
    found = blocks.sums_by_label(points[:300], points, weight, label, 7)
    gaps = blocks.distances(points[:300], points) * weight
    assert np.allclose(found, np.stack([gaps[:, label == c].sum(axis=1) for c in range(7)], axis=1), rtol=1e-10, atol=0)


def test_blocks_of_all_pairs_grow_with_the_points():
    # What is sent is a copy of every point for each block of the other side.
    for rows in (10_000, 600_000):
        assert blocks.block_count(rows, blocks.own_block(rows)) <= 60 and blocks.block_count(rows, blocks.OTHERS) <= 12


def direct_knn(points, k):
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    return {i: np.lexsort((np.arange(len(points)), gaps[i]))[:k].tolist() for i in range(len(points))}


def knn(df, k, **options):
    found = {}
    for r in nb.knn_graph(df, k, **options).orderBy("src", "rank").collect():
        found.setdefault(r.src, []).append(r.dst)
    return found


@pytest.mark.parametrize("block", [16, 2048])
def test_knn_exact_with_a_third_of_copies(spark, block):
    points = np.round(blobs(n=60, copies=90), 6)
    assert knn(frame(spark, points), 5, block=block) == direct_knn(points, 5)


def test_knn_skips_far_cells(spark):
    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(c, 0.05, (60, 2)) for c in ((0, 0), (50, 0), (0, 50), (50, 50), (99, 99), (0, 99), (99, 0), (40, 80))])
    assert knn(frame(spark, points), 4) == direct_knn(points, 4)
    placed_pivots = points[::60]
    reach = None
    from cohortlens.operators import blocks
    placed = blocks.with_nearest(frame(spark, points), placed_pivots, "vec", "cell", "gap").cache()
    reach = nb._reach(placed, placed, placed_pivots, 4)
    assert nb._route(placed, placed_pivots, reach, 0).count() < 2 * len(points)


@pytest.mark.parametrize("scale", [1.0, 1e160, 1e-200])
def test_nearest_others_are_those_of_all_distances(scale):
    rng = np.random.default_rng(0)
    points = np.round(rng.normal(size=(1500, 4)), 1) * scale
    points[5], points[9] = np.nan, np.inf
    ids = np.where(np.arange(1500) < 1400, np.arange(1500), np.arange(1500) - 1400)  # some ids twice
    with np.errstate(all="ignore"):
        gaps = blocks.distances(points, points)
        gaps[ids[:, None] == ids[None, :]] = np.inf
        order = np.argsort(gaps, axis=1, kind="stable")[:, :7]
        dist = np.take_along_axis(gaps, order, axis=1)
        found = blocks.nearest_others(ids, points, ids, points, 7)
    keep = np.isfinite(dist)
    for got, true in zip(found, (np.repeat(np.arange(1500), keep.sum(axis=1)), order[keep], dist[keep])):
        assert np.array_equal(got, true)


def test_nearest_others_measures_little_more_than_it_returns(monkeypatch):
    points = np.random.default_rng(3).normal(size=(20_000, 16)).astype(np.float32).astype(float)
    measured, plain = [], blocks.pair_distances
    monkeypatch.setattr(blocks, "pair_distances", lambda a, b: measured.append(len(a)) or plain(a, b))
    ids = np.arange(len(points))
    rows, near, dist = blocks.nearest_others(ids[:600], points[:600], ids, points, 10)
    gaps = blocks.distances(points[:600], points)
    gaps[ids[:600], ids[:600]] = np.inf
    true = np.argsort(gaps, axis=1, kind="stable")[:, :10]
    assert np.array_equal(near, true.ravel()) and np.array_equal(dist, np.take_along_axis(gaps, true, axis=1).ravel())
    assert sum(measured) < 1.5 * len(rows)


@pytest.mark.parametrize("spread", [1e-9, 1e-5, 1e-2])
def test_nearest_others_in_crowds_far_from_each_other(spread):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(5, 8))[rng.integers(0, 5, 9000)] + spread * rng.normal(size=(9000, 8))
    ids = np.arange(9000)
    rows, near, dist = blocks.nearest_others(ids[:700], points[:700], ids, points, 6)
    gaps = blocks.distances(points[:700], points)
    gaps[ids[:700], ids[:700]] = np.inf
    assert np.array_equal(near, np.argsort(gaps, axis=1, kind="stable")[:, :6].ravel())


def test_knn_counts_candidates_without_sending_them(spark):
    points = np.random.default_rng(8).normal(size=(300, 6))
    pivots = points[::10]
    bundle = np.arange(len(pivots)) // 8
    placed = frame(spark, points)
    for reach, filled in ((np.linspace(0.5, 3.0, len(pivots)), None), (None, np.zeros((len(pivots), len(pivots)), dtype=bool))):
        sent = {r["target"]: r["count"] for r in nb._route(placed, pivots, reach, 3, filled, bundle).groupBy("target").count().collect()}
        assert {r["target"]: r["n"] for r in nb._sent(placed, pivots, reach, 3, filled, bundle).collect()} == sent


def test_knn_sends_a_candidate_once_to_cells_that_share_a_block(spark):
    points = np.random.default_rng(8).normal(size=(300, 6))
    pivots = points[::10]
    placed = blocks.with_nearest(frame(spark, points), pivots, "vec", "cell", "gap").cache()
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    bundle = nb._bundles(pivots, counts, 100)
    assert sorted(set(bundle)) == list(range(bundle.max() + 1)) and 3 <= bundle.max() + 1 <= 6
    reach = np.full(len(pivots), np.inf)
    assert nb._route(placed, pivots, reach, 0, bundle=bundle).count() == 300 * (bundle.max() + 1)


def test_knn_fewer_points_than_neighbours(spark):
    points = np.array([(0.0, 0.0), (1.0, 0.0), (5.0, 0.0)])
    assert knn(frame(spark, points), 15) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}


def test_knn_probe_has_true_distances(spark):
    points = blobs(n=60)
    rows = nb.knn_graph(frame(spark, points), 5, method="probe", probe=2).collect()
    exact = direct_knn(points, 5)
    assert all(r.dist == pytest.approx(np.linalg.norm(points[r.src] - points[r.dst])) for r in rows)
    assert np.mean([r.dst in exact[r.src] for r in rows]) > 0.9


def test_knn_probe_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, points)], "id long, vec array<double>")
    found = {}
    for r in nb.knn_graph(df, 15, method="probe").collect():
        found.setdefault(r.src, set()).add(r.dst)
    hits = 0
    for i, point in zip(ids[::10], points[::10]):
        gap = np.linalg.norm(points - point, axis=1)
        hits += len(found[i] & set([j for j in ids[np.lexsort((ids, gap))] if j != i][:15]))
    assert set(map(len, found.values())) == {15} and len(found) == len(ids)
    assert hits / (15 * len(ids[::10])) >= 0.9


def test_knn_refine_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, points)], "id long, vec array<double>").repartition(5)
    found = knn(df, 15, method="refine")
    hits = 0
    for i, point in zip(ids[::10], points[::10]):
        gap = np.linalg.norm(points - point, axis=1)
        hits += len(set(found[i]) & set([j for j in ids[np.lexsort((ids, gap))] if j != i][:15]))
    assert set(map(len, found.values())) == {15} and len(found) == len(ids)
    assert hits / (15 * len(ids[::10])) >= 0.9


def test_knn_refine_is_exact_within_one_block_and_knows_copies(spark):
    points = np.round(blobs(n=60, copies=90), 6)
    assert knn(frame(spark, points), 5, method="refine") == direct_knn(points, 5)
    few = np.array([(0.0, 0.0), (1.0, 0.0), (5.0, 0.0)])
    assert knn(frame(spark, few), 15, method="refine") == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert knn(frame(spark, few).limit(0), 15, method="refine") == {}


def test_knn_probe_fills_small_cells(spark):
    points = np.random.default_rng(8).normal(size=(400, 3))
    points[:200] += 1000.0 * np.arange(200)[:, None]  # far apart: cells of a few points
    counts = {}
    for r in nb.knn_graph(frame(spark, points), 15, method="probe", probe=1, pivots=100, recall=0.0).collect():
        counts[r.src] = counts.get(r.src, 0) + 1
    assert counts == {i: 15 for i in range(400)}


def test_fuzzy_weights(spark):
    points = blobs(n=20)
    k = 6
    graph = nb.knn_graph(frame(spark, points), k).cache()
    weights = {(r.src, r.dst): r.weight for r in nb.fuzzy_weights(graph).collect()}
    near = {}
    for r in graph.collect():
        near.setdefault(r.src, []).append((r.dist, r.dst))
    half = {}
    for i, edges in near.items():
        d = np.array(sorted(x for x, _ in edges))
        past = d - d[0]
        low, high = 1e-9, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-past / mid).sum() > np.log2(k) else (mid, high)
        for x, j in edges:
            half[i, j] = np.exp(-(x - d[0]) / mid)
    for (i, j) in half:
        a, b = half.get((i, j), 0.0), half.get((j, i), 0.0)
        assert weights[min(i, j), max(i, j)] == pytest.approx(a + b - a * b, abs=1e-6)
    assert all(0 < w <= 1 + 1e-12 for w in weights.values())


def test_knn_refine_round_sends_a_vector_once_to_a_home(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cohortlens.operators import refine

    monkeypatch.setattr(refine, "LEAST", 32)
    rng, k = np.random.default_rng(4), 4
    centres = rng.normal(size=(6, 5)) * 20
    at = (centres[np.arange(240) % 6] + rng.normal(size=(240, 5))).astype(np.float32).astype(float)
    few = refine._at_home(frame(spark, at)).cache()
    home = {r["id"]: r["home"] for r in few.collect()}
    assert few.schema["vec"].dataType.simpleString() == "array<float>" and len(set(home.values())) > 4
    gap = lambda a, b: float(np.sqrt(((at[a] - at[b]) ** 2).sum()))
    lists = {a: {int(b): bool(rng.random() < 0.2) for b in rng.choice(np.flatnonzero((np.arange(240) % 6 == a % 6) & (np.arange(240) != a)), k, replace=False)} for a in range(240)}
    rows = [(a, home[a], b, home[b], gap(a, b), new) for a, own in lists.items() for b, new in own.items()]
    table = spark.createDataFrame(rows, "id long, home int, dst long, there int, dist double, new boolean")
    around, sent = refine._sent(table, few, k)
    pairs = [(r["to"], r["name"]) for r in sent.select("to", "name").collect()]
    assert len(pairs) == len(set(pairs)) and 2 * len(pairs) < around.count()
    named = {}
    for a, own in lists.items():
        for b, new in own.items():
            named.setdefault(b, []).append((not new, gap(a, b), a))
    found = {a: {(gap(a, b), b): False for b in own} for a, own in lists.items()}
    for a, own in lists.items():
        members = dict(own)
        for old, _, b in sorted(named.get(a, []))[:k]:
            members[b] = members.get(b, False) or not old
        for x, y in ((x, y) for x in members for y in members if x != y and (members[x] or members[y])):
            if gap(x, y) < max(gap(x, b) for b in lists[x]):
                found[x].setdefault((gap(x, y), y), True)
    expected = {(a, b, new) for a, own in found.items() for (_, b), new in sorted(own.items())[:k]}
    merged = refine._merged(refine._compared(table, few, k).unionAll(table.withColumn("new", F.lit(False))), k)
    assert {(r["id"], r["dst"], r["new"]) for r in merged.collect()} == expected
    assert all((r["home"], r["there"]) == (home[r["id"]], home[r["dst"]]) for r in merged.collect())
