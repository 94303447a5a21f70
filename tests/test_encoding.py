"""Hand-worked vectors, and agreement of the column and the array forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import encoding as en
from cohortlens.functions.columns import unit_sum, zscore

NUMBERS = {
    1.0: {3: 0.5, 0: 0.5},
    50.0: {15: 0.5, 1: 0.5},
    0.05: {1: 0.25, 2: 0.25, 29: 0.5},
    -2.4: {22: 0.4, 21: 0.1, 0: 0.5},
    0.0: {},
}
TEXTS = {"A": {5: 1.0}, "AB": {5: 0.5, 15: 0.35, 16: 0.15}}


def sparse(vector):
    return {i: pytest.approx(v, abs=1e-12) for i, v in enumerate(vector) if abs(v) > 1e-12}


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in NUMBERS], "x double").select("x", en.encode_number(F.col("x")).alias("v")).collect()
    for row in rows:
        assert sparse(row.v) == NUMBERS[row.x]
    for x, v in zip(NUMBERS, en.number_vectors(np.array(list(NUMBERS)))):
        assert sparse(v) == NUMBERS[x]


def test_number_forms_agree(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 200) * 10.0 ** rng.integers(-6, 7, 200), [10.0, 100.0, 0.1, 999.999, -1000.0]])
    rows = spark.createDataFrame([(float(x),) for x in values], "x double").select("x", en.encode_number(F.col("x")).alias("v")).collect()
    assert np.allclose([r.v for r in rows], en.number_vectors(np.array([r.x for r in rows])), atol=1e-12)
    assert np.allclose([sum(r.v) for r in rows], 1.0)


def test_texts(spark):
    frame = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    for row in frame.select("x", en.encode_string(F.col("x")).alias("v"), en.encode_text(F.col("x")).alias("w")).collect():
        assert sparse(row.v) == TEXTS[row.x]
        assert sparse(row.w) == TEXTS[row.x]


def test_text_forms_agree(spark):
    texts = ["crp", "héllo 😀 漢字", "x" * 63, "y" * 64, "z" * 65, "the quick brown fox " * 40]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    for row in frame.select(en.encode_string(F.col("x")).alias("v"), en.encode_text(F.col("x")).alias("w")).collect():
        assert np.allclose(row.v, row.w, atol=1e-12)


def test_empty_and_null_text(spark):
    frame = spark.createDataFrame([("",), (None,)], "x string")
    assert frame.select(en.encode_string(F.col("x")).alias("v"), en.encode_text(F.col("x")).alias("w")).distinct().collect() == [(None, None)]


def test_modular_coding(spark):
    row = spark.sql("SELECT 31.5D AS a, -1D AS b, 0D AS z").select(*[en.encode_number(F.col(c), method="mod").alias(c) for c in "abz"]).first()
    assert sparse(row.a) == {1: 1.0} and sparse(row.b) == {29: 1.0} and sparse(row.z) == {}


def test_frexp10(spark):
    row = spark.sql("SELECT 1000D AS a, 0.05D AS b, -250D AS c, 0D AS z").select(*[en.frexp10(F.col(c)).alias(c) for c in "abcz"]).first()
    assert (row.a.mantissa, row.a.exponent) == (1.0, 3)
    assert (row.b.mantissa, row.b.exponent) == (pytest.approx(0.5), -1)
    assert (row.c.mantissa, row.c.exponent) == (-2.5, 2)
    assert (row.z.mantissa, row.z.exponent) == (0.0, 0)


def test_combinations_agree(spark):
    rng = np.random.default_rng(2)
    base, key, value = (en.unit_rows(rng.random((20, 30))) for _ in range(3))
    rows = [(b.tolist(), k.tolist(), v.tolist()) for b, k, v in zip(base, key, value)]
    frame = spark.createDataFrame(rows, "b array<double>, k array<double>, v array<double>")
    out = frame.select("b", "k", "v", en.combine_last(F.col("b"), F.col("k"), F.col("v")).alias("l"), en.combine_sum(F.col("b"), F.col("k"), F.col("v")).alias("s")).collect()
    for r in out:
        b, k, v = (np.array([x]) for x in (r.b, r.k, r.v))
        assert np.allclose(r.l, en.mix_last(b, k, v)[0]) and np.allclose(r.s, en.mix_sum(b, k, v)[0])
        assert r.s[29] == pytest.approx((r.b[29] + r.k[0] + r.v[1]) / 3)


def test_unit_sum_and_zscore(spark):
    row = spark.sql("SELECT array(1D, 3D, 2D) AS v, array(2D, 2D) AS flat").select(
        unit_sum(F.col("v")).alias("u"), unit_sum(F.col("flat")).alias("f"), zscore(F.col("v")).alias("z"), zscore(F.col("flat")).alias("n")
    ).first()
    assert row.u == pytest.approx([0, 2 / 3, 1 / 3]) and row.f == [0, 0]
    assert sum(row.z) == pytest.approx(0) and np.std(row.z) == pytest.approx(1)
    assert row.n is None
