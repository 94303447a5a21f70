"""Chi-square, contingency, histogram, profile."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import frames as fr
from cohortlens.operators import screen as sc
from cohortlens.plans.views import Study


def tables(spark, *rows):
    return spark.createDataFrame([(f"t{i}", *r) for i, r in enumerate(rows)], "lab string, high_0 long, high_1 long, low_0 long, low_1 long")


def test_uncorrected(spark):
    row = sc.chi2_screen(tables(spark, (10, 20, 30, 15)), correction=False).first()
    assert row.chi_stat == pytest.approx(8.0357, abs=1e-4) and row.pval == pytest.approx(0.004586, abs=1e-6) and row.dof == 1


def test_corrected(spark):
    row = sc.chi2_screen(tables(spark, (10, 20, 30, 15))).first()
    e = np.array([30 * 40, 30 * 35, 45 * 40, 45 * 35]) / 75
    stat = ((np.abs(e - [10, 20, 30, 15]) - 0.5) ** 2 / e).sum()
    assert row.chi_stat == pytest.approx(stat) and row.pval == pytest.approx(math.erfc(math.sqrt(stat / 2)))
    assert sum(row[f"exp_{c}"] for c in sc.CELLS) == pytest.approx(75)


def test_degenerate_and_balanced(spark):
    rows = {r.lab: r for r in sc.chi2_screen(tables(spark, (0, 0, 5, 5), (0, 0, 0, 0), (10, 10, 10, 10))).collect()}
    for lab in ("t0", "t1"):
        assert (rows[lab].chi_stat, rows[lab].pval, rows[lab].dof, rows[lab].status) == (None, None, None, "degenerate")
    assert (rows["t2"].chi_stat, rows["t2"].pval, rows["t2"].status) == (0.0, 1.0, "ok")


def test_tail(spark):
    assert spark.sql("SELECT 3.841458820694124D AS x").select(sc.chi2_tail("x")).first()[0] == pytest.approx(0.05)


def test_text_cells_and_ratios(spark):
    screened = sc.chi2_screen(tables(spark, (10, 20, 30, 15), (0, 0, 5, 5)))
    rows = {r.lab: r for r in sc.ratios_from_text(sc.with_text_cells(screened)).collect()}
    assert rows["t0"].observed == "10.0, 20.0, 30.0, 15.0" and rows["t0"].expctd == "16.0, 14.0, 24.0, 21.0"
    assert rows["t0"].ratio_high_0 == pytest.approx(10 / 16)
    assert rows["t1"].ratio_high_0 is None
    assert sc.with_array_cells(screened).where("lab = 't0'").first().expected == [16.0, 14.0, 24.0, 21.0]
    assert sc.enrichment(screened).where("lab = 't0'").first().ratio_low_1 == pytest.approx(15 / 21)


def test_counts_and_missing_group(spark):
    frame = spark.createDataFrame([(0, 1, None), (0, 0, None), (0, 1, 1)], "cluster int, a int, b int")
    table = {r.lab: r for r in sc.contingency(sc.high_low_counts(frame, "cluster", ["a", "b"]), "cluster").collect()}
    assert tuple(table["a"])[1:] == (2, 0, 1, 0) and tuple(table["b"])[1:] == (1, 0, 0, 0)


def test_counts_of_several_columns(spark):
    frame = spark.range(20).select((F.col("id") % 2).alias("cluster"), *[(F.col("id") % n == 0).cast("int").alias(f"x{n}") for n in range(2, 7)])
    got = {(r.lab, r.cluster): (r.high, r.low) for r in sc.high_low_counts(frame, "cluster", [f"x{n}" for n in range(2, 7)]).collect()}
    for n in range(2, 7):
        for g in (0, 1):
            ids = [i for i in range(20) if i % 2 == g]
            assert got[(f"x{n}", g)] == (sum(i % n == 0 for i in ids), sum(i % n != 0 for i in ids))


def automatic_bins(values):
    spread = values.max() - values.min()
    if not spread:
        return 1
    q1, q3 = np.percentile(values, [25, 75])
    widths = [spread / (np.log2(len(values)) + 1), 2 * (q3 - q1) / len(values) ** (1 / 3)]
    width = min(widths) if widths[1] else widths[0]
    return math.ceil(spread / (max(width, 1) if values.dtype.kind == "i" else width))


@pytest.mark.parametrize("kind", ["normal", "skewed", "constant", "two_values", "integers", "many_equal"])
def test_histogram_matches_numpy(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(0, 1, 500),
        "skewed": rng.lognormal(0, 2, 500),
        "constant": np.full(9, 3.0),
        "two_values": np.array([0.0, 10.0]),
        "integers": rng.integers(0, 6, 300),
        "many_equal": np.concatenate([np.zeros(300), rng.random(40)]),
    }[kind]
    dtype = "long" if kind == "integers" else "double"
    frame = spark.createDataFrame([(x.item(),) for x in values], f"x {dtype}")
    rows = sorted(sc.auto_histogram(frame, "x", filled=False).collect())
    counts, edges = np.histogram(values, bins=automatic_bins(values))
    assert [r.n for r in rows] == counts.tolist()
    assert np.allclose([r.low for r in rows] + [rows[-1].high], edges)


INF, TINY = float("inf"), 5e-324


@pytest.mark.parametrize("odd", [[INF], [-INF, INF], [float("nan")], [None], [INF, float("nan"), None]])
def test_histogram_leaves_out_what_is_not_finite(spark, odd):
    plain = [float(x) for x in range(50)]
    def bins(values):
        return sorted(sc.auto_histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect())

    assert bins(plain + odd) == bins(plain)


def test_histogram_of_subnormal_and_heavy_tailed_values(spark):
    tiny = spark.createDataFrame([(i * TINY,) for i in range(7)], "x double")
    assert sum(r.n for r in sc.auto_histogram(tiny, "x", filled=False).collect()) == 7
    close = spark.createDataFrame([(1.0,), (math.nextafter(1.0, 2.0),)] * 5, "x double")
    assert sum(r.n for r in sc.auto_histogram(close, "x").collect()) == 10
    tail = [float(i % 10) for i in range(400)] + [1e15]
    rows = sc.auto_histogram(spark.createDataFrame([(v,) for v in tail], "x double"), "x").collect()
    assert sum(r.n for r in rows) == 401 and len(rows) <= 11
    assert sc.auto_histogram(spark.createDataFrame([(INF,), (None,)], "x double"), "x").count() == 0


def test_histogram_with_one_far_value_returns_at_once(spark):
    frame = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x").unionAll(spark.sql("SELECT 1e10D AS x"))
    rows = sc.auto_histogram(frame, "x").collect()
    assert sum(r.n for r in rows) == 1001 and len(rows) < 1002
    with pytest.raises(ValueError, match="bins"):
        sc.auto_histogram(frame, "x", filled=False)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 401, 30_011])
def test_quartiles_are_exact(spark, n):
    values = np.random.default_rng(n).lognormal(0, 3, n).round(2)
    frame = spark.createDataFrame([(float(x),) for x in values], "x double")
    rows = sorted(sc.auto_histogram(frame, "x").collect())
    counts, edges = np.histogram(values, bins=automatic_bins(values))
    assert [r.n for r in rows] == [c for c in counts.tolist() if c]
    assert rows[0].high - rows[0].low == pytest.approx(edges[1] - edges[0])


@pytest.mark.parametrize("stat, dof, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05),
                                           (0.0, 3, 1.0), (1e-9, 2, math.exp(-5e-10)), (60.0, 2, math.exp(-30)), (0.3, 2, math.exp(-0.15)), (1400.0, 1000, None)])
def test_tails(spark, stat, dof, p):
    found = spark.range(1).select(sc.chi2_tail(F.lit(stat), F.lit(dof))).first()[0]
    if p is None:  # even degrees of freedom: a finite sum
        log = [i * math.log(stat / 2) - stat / 2 - math.lgamma(i + 1) for i in range(dof // 2)]
        p = math.fsum(map(math.exp, log))
    assert found == pytest.approx(p, rel=1e-9)


def test_tables_of_any_size(spark):
    rng = np.random.default_rng(8)
    for r, c in ((2, 2), (2, 3), (4, 5)):
        o = rng.integers(0, 30, (r, c)) + 1
        o[0, 0] = 0
        cells = spark.createDataFrame([("t", i, j, int(o[i, j])) for i in range(r) for j in range(c) if o[i, j]] + [("one", 0, j, 3) for j in range(3)] + [("empty", i, j, 3 * i) for i in range(2) for j in range(2)], "lab string, row int, col int, n long")
        rows = {x.lab: x for x in sc.chi2_tables(cells, "lab", "row", "col", "n").collect()}
        e = o.sum(axis=1, keepdims=True) * o.sum(axis=0) / o.sum()
        assert rows["t"].chi_stat == pytest.approx(((o - e) ** 2 / e).sum()) and rows["t"].dof == (r - 1) * (c - 1) and 0 < rows["t"].pval < 1
        assert all((rows[x].chi_stat, rows[x].dof, rows[x].pval, rows[x].status) == (None, None, None, "degenerate") for x in ("one", "empty"))


def test_order_statistics(spark):
    rng = np.random.default_rng(3)
    values = np.sort(np.concatenate([rng.lognormal(0, 4, 300), np.full(150, 2.0)]))
    frame = spark.createDataFrame([(float(x),) for x in values], "x double")
    ranks = [0, 1, 112, 225, 300, 449]
    found = sc.order_statistics(frame, "x", ranks, float(values[0]), float(values[-1]))
    assert [found[r] for r in ranks] == [values[r] for r in ranks]


def test_profile_and_rank(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, 5.0, None)], "a int, b double, c string")
    assert {tuple(r) for r in fr.column_profile(frame).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    ranked = fr.rank_desc(spark.createDataFrame([("p", 1.0), ("q", None), ("r", 1.0), ("s", 9.0)], "lab string, chi double"), "chi", "lab")
    assert [(r.rank, r.lab) for r in ranked.orderBy("rank").collect()] == [(0, "s"), (1, "p"), (2, "r"), (3, "q")]


def test_labs_are_not_widened_before_their_patient_is_known(spark, tmp_path):
    lines = [(1, 1, 50.0, "2024-01-02"), (1, 1, 10.0, "2024-01-01"), (2, 1, 20.0, "2024-01-05"), (3, 2, None, "2024-02-01"), (4, 2, 45.0, None), (9, 1, 1.0, "2024-01-01")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, None), (4, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Brand#1"), (2, "Brand#2")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    labs = Study(spark, str(tmp_path)).labs()
    rows = {r.patient_id: r for r in labs.collect()}
    assert {k: r.n_encounters for k, r in rows.items()} == {7: 2, None: 1, 8: 1}
    assert (rows[7].lab_Brand1, rows[7].lab_Brand1_neg, rows[7].lab_Brand1_pos, str(rows[7].lab_Brand1_first), str(rows[7].lab_Brand1_last)) == (1, 3, 1, "2024-01-01", "2024-01-05")
    assert (rows[None].lab_Brand2, rows[8].lab_Brand2, rows[8].lab_Brand2_pos, rows[8].lab_Brand2_first) == (None, 1, 1, None)
    # Under the aggregate by patient there is the shuffle by patient and no other aggregate, which would hold a wide row for each line or order.
    plan = labs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.index("Aggregate [") < plan.index("RepartitionByExpression [patient_id") and "distinct" not in plan
