"""Projections, filters, joins, sources."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from cohortlens.operators import cohort as co
from cohortlens.operators import frames as fr
from cohortlens.operators import overlay as ov
from cohortlens.session import scratch_path
from cohortlens.sources import tables as tb


def test_comparing_with_null_keeps_nothing(spark):
    frame = spark.createDataFrame([(1, 2.0), (2, None)], "id int, v double")
    assert frame.where("v != null").count() == 0
    assert fr.where_present(frame, "v").count() == 1


def test_nan_keys(spark):
    frame = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "k double")
    assert [r.k for r in fr.drop_nan_key(frame, "k").collect()] == [1.0]
    assert frame.where("k = k").count() == 2  # NaN equals itself here
    assert fr.drop_nan_key(spark.range(3), "id").count() == 3


def test_columns(spark):
    frame = spark.range(1).select("id", *[F.lit(1).alias(c) for c in ("member", "enc", "a", "a_first", "a_last", "a_neg", "a_pos")])
    assert fr.slice_columns(frame, 2, key="id").columns == ["id", "a", "a_first", "a_last", "a_neg", "a_pos"]
    assert fr.slice_columns(frame, 0, 1).columns == ["id"]
    assert fr.drop_matching(frame, ["first", "last", "neg", "pos"]).columns == ["id", "member", "enc", "a"]
    assert fr.select_listed(frame, ["a", "member"], key="id").columns == ["id", "member", "a"]
    doubled = frame.select("id", "a", F.lit(9).alias("a"))
    assert fr.dedup_columns(doubled).collect() == [(0, 1)]
    assert fr.rename(frame, {"id": "patient"}).columns[0] == "patient"


def test_documents_keep_nulls_and_order(spark):
    frame = spark.createDataFrame([(1, None, "x")], "id int, b double, a string")
    doc = fr.to_documents(frame, "id").first().doc
    assert list(json.loads(doc).items()) == [("b", None), ("a", "x")]


def test_composite_key_null_and_collision(spark):
    frame = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x")], "p string, q string")
    assert [r.k for r in fr.with_key(frame, "k", ["p", "q"]).collect()] == ["abc", "abc", None]
    assert [r.k for r in fr.with_key(frame, "k", ["p", "q"], sep="|").collect()] == ["a|bc", "ab|c", None]


def test_first_non_null(spark):
    rows = [(1, 3, None, "c"), (1, 1, None, None), (1, 2, 5.0, "b"), (2, 1, None, None)]
    frame = spark.createDataFrame(rows, "k int, t int, v double, s string")
    found = {r.k: (r.v, r.s) for r in fr.first_non_null(frame, "k", ["t"]).collect()}
    assert found == {1: (5.0, "b"), 2: (None, None)}


def test_flagged_records_multiplicity_and_null_flag(spark):
    records = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "a"), (4, None)], "patient_id long, diagnosis_id string")
    dx = spark.createDataFrame([("a", True), ("a", True), ("b", None), ("c", False)], "diagnosis_id string, flag boolean")
    cohort = spark.createDataFrame([(1,), (2,), (9,)], "patient_id long")
    assert [r.patient_id for r in co.flagged_records(records, dx, cohort, "flag").collect()] == [1, 1, 1, 1]
    outer = co.right(co.left(records, dx, "diagnosis_id"), cohort, "patient_id")
    assert fr.where_true(outer, "flag").count() == 4 and outer.count() == 6
    assert [r.patient_id for r in co.flagged_ids([records, records], dx, cohort, "flag").collect()] == [1]


def test_outer_chain_is_planned_as_inner(spark):
    records = spark.createDataFrame([(1, "a")], "patient_id long, diagnosis_id string")
    dx = spark.createDataFrame([("a", True)], "diagnosis_id string, flag boolean")
    cohort = spark.createDataFrame([(1,)], "patient_id long")
    chain = fr.where_true(co.right(co.left(records, dx, "diagnosis_id"), cohort, "patient_id"), "flag")
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert "RightOuter" not in plan and "LeftOuter" not in plan


def test_explode_drops_null_and_empty(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, array('a','b')), (2, CAST(NULL AS ARRAY<STRING>)), (3, CAST(array() AS ARRAY<STRING>)) AS t(id, c)")
    assert sorted(tuple(r) for r in co.explode_codes(frame, "c").collect()) == [(1, "a"), (1, "b")]
    assert [r.id for r in fr.where_longer(frame, "c", 1).collect()] == [1]


def test_overlay_and_jitter(spark):
    groups = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "id int, cluster int")
    flags = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0)], "id int, a int, b int")
    marked = ov.overlay(groups, flags, "id", [("both", ["a", "b"]), ("a", ["a"])])
    assert {r.id: r.marker for r in marked.collect()} == {1: "both", 2: "a", 3: None}
    assert {(r.cluster, r.marker, r.n) for r in ov.overlay_counts(marked).collect()} == {(0, "both", 1), (1, "a", 1), (1, None, 1)}
    still = spark.range(500).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    moved = ov.jitter(still, ["x", "y"], -0.1, 0.1, "id", seed=4).collect()
    assert sorted(moved) == sorted(ov.jitter(still.repartition(7), ["x", "y"], -0.1, 0.1, "id", seed=4).collect())
    assert all(0.9 <= r.x < 1.1 for r in moved) and len({r.x for r in moved}) > 400 and any(r.x != r.y for r in moved)


def test_parquet_modes(spark):
    path = scratch_path(spark, "modes")
    tb.write_parquet(spark.range(3), path)
    with pytest.raises(AnalysisException):
        tb.write_parquet(spark.range(5), path)
    tb.write_parquet(spark.range(5), path, mode="overwrite")
    assert tb.read_parquet(spark, path).count() == 5


def test_a_result_is_replaced_as_a_whole(spark):
    path = scratch_path(spark, "replaced")
    with pytest.raises(FileNotFoundError):
        tb.read_replaced(spark, path)
    tb.replace_parquet(spark.range(3), path)
    assert tb.read_replaced(spark, path).count() == 3
    broken = spark.range(100_000, numPartitions=8).select(F.when(F.col("id") == 99_999, F.raise_error(F.lit("stopped"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        tb.replace_parquet(broken, path)
    assert tb.read_replaced(spark, path).count() == 3
    tb.replace_parquet(tb.read_replaced(spark, path).union(spark.range(4)), path)
    assert tb.read_replaced(spark, path).count() == 7
    files, root = tb._file_system(spark, path)
    assert sorted(x.getPath().getName()[:8] for x in files.listStatus(root)) == ["_current", "version-"]


def test_named_tables(spark):
    tb.register(spark.range(2).selectExpr("id", "id * 2 AS twice"), "named")
    assert tb.read_table(spark, "named", ["twice"]).columns == ["twice"]
    assert tb.query_table(spark, "named").count() == 2
    assert sorted(r[0] for r in tb.query_table(spark, "named", ["twice"]).collect()) == [0, 2]


def test_keyed_json(spark):
    docs = spark.createDataFrame([('a"b', '{"x": 1}'), ("c", '{"y": {"z": 0.0}}')], "k string, doc string")
    path = scratch_path(spark, "lines")
    tb.write_keyed_lines(docs, path, "k")
    back = {r.key: json.loads(r.doc) for r in tb.read_keyed_json(spark, path).collect()}
    assert back == {'a"b': {"x": 1}, "c": {"y": {"z": 0.0}}}
    several = scratch_path(spark, "several")
    spark.createDataFrame([('{"p": {"x": 1}, "q": {"x": 2}}',)], "value string").write.text(several)
    assert {r.key for r in tb.read_keyed_json(spark, several).collect()} == {"p", "q"}


@pytest.mark.parametrize("line", ["no json", '{"a": 1', '[1]'])
def test_a_broken_line_of_keyed_json_fails(spark, line):
    path = scratch_path(spark, "broken")
    spark.createDataFrame([('{"p": {"x": 1}}',), ("",), (line,)], "value string").write.text(path)
    with pytest.raises((PySparkException, Py4JJavaError)):
        tb.read_keyed_json(spark, path).collect()


OBJECT = {f"k{i}": [{"a": i, "t": 'q" \\ , { é\n' * (i % 4), "l": [1, [2, {}], "}"]}, "text, \\" * i, None, 1.5, {}, "x" * 3000][i % 6] for i in range(60)}


@pytest.mark.parametrize("size", [700, 10**7])
@pytest.mark.parametrize("indent", [None, 2])
def test_whole_objects_are_read_in_blocks(spark, tmp_path, size, indent):
    (tmp_path / "one.json").write_text(" " + json.dumps(OBJECT, indent=indent, ensure_ascii=bool(indent)) + "\n\n", encoding="utf-8")
    (tmp_path / "two.json").write_text('{ }')
    (tmp_path / "three.json").write_text('{"z" :\n{"b":\n[] }}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows = tb.read_keyed_json(spark, str(tmp_path), form="object").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 61 and {r.key: json.loads(r.doc) for r in rows} == {**OBJECT, "z": {"b": []}}


@pytest.mark.parametrize("text", ['{"a": 1', '{"a": 1}}', '{"a": 1} {"b": 2}', '[{"a": 1}]', '{"a": 1,}', '{"a"}', '{1: 2}', '"a"', '{"a": "b}', '{"a": , "b": 1}'])
def test_malformed_objects_fail(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    with pytest.raises((ValueError, PySparkException, Py4JJavaError)):
        tb.read_keyed_json(spark, str(tmp_path), form="object").collect()


def test_tsv(spark):
    path = scratch_path(spark, "tsv")
    tb.write_tsv(spark.createDataFrame([(1, 2, 0.125)], "id int, n int, c double"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["1\t2\t0.125"]
