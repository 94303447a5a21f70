"""Kept cells, both combinations, missing rows and nested documents."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortlens.functions import encoding as en
from cohortlens.operators import fingerprint as fp


def expected(triples, combine):
    """``triples``: (parent or None, name, value) in order of use."""
    parts = []
    for parent, name, value in triples:
        base = en.text_vector(parent)[None] if parent else np.zeros((1, 30))
        if isinstance(value, str):
            vector = en.text_vector(value)[None]
        else:
            vector = en.number_vectors(np.array([np.nan if value is None else value], dtype=float))
        parts.append((en.mix_last if combine == "last" else en.mix_sum)(base, en.text_vector(name)[None], vector)[0])
    total = parts[-1] if combine == "last" else np.sum(parts, axis=0)
    return (total - total.mean()) / total.std()


def test_kept_cells(spark):
    frame = spark.sql("""SELECT 1 AS id, 0 AS zero, CAST(NULL AS INT) AS none, false AS off, 0.0D AS real0, double('NaN') AS nan,
        '' AS empty, 'x' AS text, CAST(0 AS DECIMAL(5,2)) AS dec0, CAST(1.5 AS DECIMAL(5,2)) AS dec, date'2020-01-01' AS day,
        array(1) AS list, CAST(array() AS ARRAY<INT>) AS nolist""")
    kept = {r.name: (r.num, r.txt) for r in fp.statements(frame, "id").collect()}
    assert kept == {"zero": (0.0, None), "off": (0.0, None), "text": (None, "x"), "dec": (None, None), "day": (None, None), "list": (None, None)}
    assert fp.statement_counts(frame, "id").first().statements == 6


@pytest.mark.parametrize("combine", ["last", "sum"])
def test_flat(spark, combine):
    frame = spark.createDataFrame([(1, 2.5, "ab", 7), (2, 1.5, "cd", None), (3, 0.0, "", None)], "id int, a double, b string, c int")
    rows = {r.id: r for r in fp.fingerprint(frame, "id", combine=combine, decimals=None).collect()}
    assert np.allclose(rows[1].fp, expected([(None, "a", 2.5), (None, "b", "ab"), (None, "c", 7)], combine))
    assert np.allclose(rows[2].fp, expected([(None, "a", 1.5), (None, "b", "cd")], combine))
    assert (rows[3].statements, rows[3].fp) == (0, None)
    for i in (1, 2):
        assert np.mean(rows[i].fp) == pytest.approx(0, abs=1e-12) and np.std(rows[i].fp) == pytest.approx(1)


@pytest.mark.parametrize("combine", ["last", "sum"])
def test_flat_is_independent_of_partitions(spark, combine):
    frame = spark.range(200).select("id", (F.col("id") % 7 / 3).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("b"))
    one = sorted(fp.fingerprint(frame.repartition(1), "id", combine=combine).collect())
    assert one == sorted(fp.fingerprint(frame.repartition(7), "id", combine=combine).collect())


def test_number_coding_is_a_choice(spark):
    frame = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2.5, -7.25, 31, 1e6, 0.3])], "id int, a double")
    code = {r.id: r.v for r in frame.select("id", en.encode_number(F.col("a"), method="mod").alias("v")).collect()}
    for combine, mix in (("last", en.mix_last), ("sum", en.mix_sum)):
        for r in fp.fingerprint(frame, "id", combine=combine, decimals=None, numeric="mod").collect():
            total = mix(np.zeros((1, 30)), en.text_vector("a")[None], np.array([code[r.id]]))[0]
            assert np.allclose(r.fp, (total - total.mean()) / total.std())


def test_portions_of_any_size():
    whole = [np.array([3, 0, 5, 40_000, 2]), np.array([], dtype=int), np.zeros(4, dtype=int)]
    for sizes in whole:
        parts = fp._portions(sizes)
        assert [i for rows, _ in parts for i in range(rows.start, rows.stop)] == list(range(len(sizes)))
        assert all(c.stop - c.start == sizes[r].sum() for r, c in parts)


def test_wide_table(spark):
    frame = spark.createDataFrame([(1, 2.5)], "id int, a double")
    assert fp.wide(fp.fingerprint(frame, "id"), "id").columns == ["id", "statements"] + [f"c{i}" for i in range(30)]


def test_nested_columns_are_sent_to_the_document_form(spark):
    with pytest.raises(ValueError, match="fingerprint_nested"):
        fp.fingerprint(spark.sql("SELECT 1 AS id, struct(1 AS a) AS s"), "id")


DOCS = {
    1: {"b": 1, "a": {"z": 0.0, "y": 10.0, "x": [1], "w": {}}, "c": "1", "d": None, "e": True, "f": 1e3, "h": [], "i": -0.0},
    2: {"a": {"b": {"c": 1, "d": 0}}},
    3: {},
    4: {"k": {"only": None}},
    5: {"t": "x" * 300, "n": {"deep": "y"}},
}
# (parent, name, value); objects stand as the count of their kept fields
TRIPLES = {
    1: [(None, "b", 1), (None, "a", 2), (None, "c", "1"), (None, "e", 1), (None, "f", 1000.0), ("a", "y", 10.0), ("a", "x", None)],
    2: [(None, "a", 1), ("a", "b", 2), ("b", "c", 1), ("b", "d", 0)],
    4: [(None, "k", 0)],
    5: [(None, "t", "x" * 300), (None, "n", 1), ("n", "deep", "y")],
}


def documents(spark):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in DOCS.items()], "id int, doc string")


@pytest.mark.parametrize("combine", ["last", "sum"])
def test_nested(spark, combine):
    rows = {r.id: r for r in fp.fingerprint_nested(documents(spark), "id", "doc", combine=combine, decimals=None).collect()}
    assert (rows[3].statements, rows[3].fp) == (0, None)
    for i, triples in TRIPLES.items():
        outer = [t for t in triples if t[0] is None]
        assert rows[i].statements == len(triples)
        assert np.allclose(rows[i].fp, expected(outer if combine == "last" else triples, combine))


def test_nested_triples(spark):
    found = {}
    for r in fp.nested_triples(documents(spark), "id", "doc").collect():
        found.setdefault(r.id, set()).add((r.depth, r.parent, r.name, r.num, r.txt))
    assert found[2] == {(0, "root", "a", 1.0, None), (1, "a", "b", 2.0, None), (2, "b", "c", 1.0, None), (2, "b", "d", 0.0, None)}
    assert found[4] == {(0, "root", "k", 0.0, None)}


def test_repeated_key_keeps_place_and_last_value(spark):
    frame = spark.createDataFrame([(1, '{"a": 1, "b": 2, "a": 3}')], "id int, doc string")
    row = fp.fingerprint_nested(frame, "id", "doc", decimals=None).first()
    assert row.statements == 2 and np.allclose(row.fp, expected([(None, "b", 2)], "last"))
    assert {(r.name, r.num) for r in fp.nested_triples(frame, "id", "doc").collect()} == {("a", 3.0), ("b", 2.0)}


def test_deep_documents(spark):
    doc = 1
    for i in range(300):
        doc = {f"k{i}": doc, "leaf": 0}
    rows = fp.nested_triples(spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string"), "id", "doc").collect()
    assert len(rows) == 600 and max(r.depth for r in rows) == 299


def test_long_numbers_and_very_deep_documents(spark):
    deep = "{\"k\": " * 12_000 + "{\"leaf\": 0}" + "}" * 12_000
    docs = [(1, "{\"n\": " + "9" * 400 + ", \"m\": 1}"), (2, "{\"n\": " + "-" + "9" * 5000 + "}"), (3, deep), (4, "{\"r\": 1e999}")]
    frame = spark.createDataFrame(docs, "id int, doc string")
    triples = {}
    for r in fp.nested_triples(frame, "id", "doc").collect():
        triples.setdefault(r.id, []).append((r.depth, r.parent, r.name, r.num))
    assert triples[1] == [(0, "root", "n", float("inf")), (0, "root", "m", 1.0)] and triples[2] == [(0, "root", "n", float("-inf"))]
    assert triples[4] == [(0, "root", "r", float("inf"))]
    assert len(triples[3]) == 12_001 and (12_000, "k", "leaf", 0.0) in triples[3]
    rows = {r.id: r for r in fp.fingerprint_nested(frame, "id", "doc", combine="sum", decimals=None).collect()}
    assert np.allclose(rows[1].fp, expected([(None, "n", None), (None, "m", 1)], "sum")) and rows[3].statements == 12_001


SCALARS = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=6))
ANY_JSON = st.recursive(SCALARS, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(ANY_JSON, st.sampled_from([None, 1]))
def test_the_parser_without_recursion_agrees(value, indent):
    text = json.dumps(value, indent=indent)
    assert fp._parsed_deep(text) == json.loads(text, parse_int=float)


@pytest.mark.parametrize("text", ["", "{", "}", "[1,]", "{,}", '{"a" 1}', '{"a":}', "[1 2]", "{1: 2}", "[}", "1 2", '{"a": 1,}', "[1]]", '"open', "NaN", "nul"])
def test_the_parser_without_recursion_refuses(text):
    with pytest.raises(ValueError):
        fp._parsed_deep(text)


def test_time_is_linear_in_fields(spark):
    def seconds(m):
        text = json.dumps({f"o{i}": {"a": i, "b": "x"} for i in range(m)})
        start = time.perf_counter()
        assert len(fp._document_levels(text)[1]) == 2 * m
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(64_000) for _ in range(3)) < 3.5 * min(seconds(32_000) for _ in range(3))


def test_not_json_fails(spark):
    with pytest.raises((PySparkException, Py4JJavaError)):
        fp.fingerprint_nested(spark.createDataFrame([(1, "no json")], "id int, doc string"), "id", "doc").collect()
