"""Cohort selection, frame operators, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import join_numbers, split_numbers
from cohortlens.operators import cohort as co
from cohortlens.operators import frames as fr
from cohortlens.plans.registry import query, rounded, rounded_sql
from cohortlens.plans.views import DIAGNOSES, LABS, Study, with_views
from cohortlens.session import scratch_path
from cohortlens.sources import tables as tb
from cohortlens.sources.keyed_json import write_keyed_object

_MAP = ["dx_id", "instance", "flag"]


def dx_map(study: Study) -> DataFrame:
    """The diagnosis map, read by name with a column list and given its composite key."""
    tb.register(study.dx_map(), "fx_dx_map")
    return fr.with_key(tb.query_table(study.spark, "fx_dx_map", _MAP), "diagnosis_id", ["instance", "dx_id"])


def problem_list(study: Study) -> DataFrame:
    tb.register(study.problems(), "fx_problem")
    return tb.read_table(study.spark, "fx_problem")


def cohort_ids(study: Study) -> DataFrame:
    """Cohort members flagged in either record kind."""
    encounters = co.explode_codes(study.encounters(), "diagnosis_id")
    return co.flagged_ids([problem_list(study), encounters], dx_map(study), study.cohort(), "flag")


_FLAGGED_P = (
    "fx_p AS (SELECT p.patient_id, p.diagnosis_id, m.instance, m.dx_id FROM fx_problem p LEFT JOIN fx_dx_map m USING (diagnosis_id) "
    "JOIN fx_cohort c ON p.patient_id = c.patient_id WHERE m.flag)"
)
_FLAGGED_E = (
    "fx_x AS (SELECT encounter_id, patient_id, visit_date, unnest(diagnosis_id) AS diagnosis_id FROM fx_encounter), "
    "fx_e AS (SELECT e.encounter_id, e.patient_id, e.visit_date, e.diagnosis_id, m.dx_id FROM fx_x e JOIN fx_dx_map m USING (diagnosis_id) "
    "JOIN fx_cohort c ON e.patient_id = c.patient_id WHERE m.flag)"
)
_IDS = "fx_ids AS (SELECT patient_id FROM fx_e UNION SELECT patient_id FROM fx_p)"
COHORT_VIEWS = ("fx_cohort", "fx_dx_map", "fx_problem", "fx_encounter")
COHORT_CTES = f"WITH {_FLAGGED_P}, {_FLAGGED_E}, {_IDS}"


@query("cohort_flagged_problems", with_views(
    f"WITH {_FLAGGED_P} SELECT patient_id, diagnosis_id, instance, dx_id FROM fx_p", "fx_cohort", "fx_dx_map", "fx_problem"))
def cohort_flagged_problems(study: Study) -> DataFrame:
    found = co.flagged_records(problem_list(study), dx_map(study), study.cohort(), "flag")
    return found.select("patient_id", "diagnosis_id", "instance", "dx_id")


@query("cohort_flagged_encounters", with_views(
    f"WITH {_FLAGGED_E} SELECT encounter_id, patient_id, visit_date, diagnosis_id, dx_id FROM fx_e", "fx_cohort", "fx_dx_map", "fx_encounter"))
def cohort_flagged_encounters(study: Study) -> DataFrame:
    encounters = co.explode_codes(study.encounters(), "diagnosis_id")
    found = co.flagged_records(encounters, dx_map(study), study.cohort(), "flag")
    return found.select("encounter_id", "patient_id", "visit_date", "diagnosis_id", "dx_id")


@query("cohort_outer_joins", with_views(
    "SELECT p.patient_id, p.diagnosis_id, m.dx_id FROM fx_problem p LEFT JOIN fx_dx_map m USING (diagnosis_id) "
    "RIGHT JOIN fx_cohort c ON p.patient_id = c.patient_id WHERE m.flag", "fx_cohort", "fx_dx_map", "fx_problem"))
def cohort_outer_joins(study: Study) -> DataFrame:
    """The chain as first written: left to the map, right to the cohort, then the flag."""
    joined = co.right(co.left(problem_list(study), dx_map(study), "diagnosis_id"), study.cohort(), "patient_id")
    return fr.where_true(joined, "flag").select("patient_id", "diagnosis_id", "dx_id")


@query("cohort_coverage", with_views(
    "SELECT c.patient_id, CAST(count(p.diagnosis_id) AS BIGINT) AS n_problems, CAST(count(m.flag) AS BIGINT) AS n_mapped "
    "FROM fx_problem p LEFT JOIN fx_dx_map m ON p.diagnosis_id = m.diagnosis_id AND m.flag "
    "RIGHT JOIN fx_cohort c ON p.patient_id = c.patient_id GROUP BY c.patient_id", "fx_cohort", "fx_dx_map", "fx_problem"))
def cohort_coverage(study: Study) -> DataFrame:
    """Both outer joins with their null-extended rows kept: problems per member, and how many are flagged."""
    flagged = fr.where_true(dx_map(study), "flag").select("diagnosis_id", "flag")
    joined = co.right(co.left(problem_list(study), flagged, "diagnosis_id"), study.cohort(), "patient_id")
    return joined.groupBy("patient_id").agg(F.count("diagnosis_id").alias("n_problems"), F.count("flag").alias("n_mapped"))


@query("cohort_union", with_views(f"{COHORT_CTES} SELECT patient_id, 1 AS member FROM fx_ids", *COHORT_VIEWS))
def cohort_union(study: Study) -> DataFrame:
    """Record by record, then a set union of the two id lists."""
    p = co.flagged_records(problem_list(study), dx_map(study), study.cohort(), "flag")
    encounters = co.explode_codes(study.encounters(), "diagnosis_id")
    e = co.flagged_records(encounters, dx_map(study), study.cohort(), "flag")
    return fr.with_constant(fr.union_distinct(e.select("patient_id"), p.select("patient_id")), "member", 1)


@query("cohort_ids", with_views(f"{COHORT_CTES} SELECT patient_id FROM fx_ids", *COHORT_VIEWS))
def cohort_ids_query(study: Study) -> DataFrame:
    return cohort_ids(study)


@query("cohort_labs", with_views(
    f"{COHORT_CTES} SELECT patient_id, {', '.join(LABS)} FROM fx_ids JOIN fx_labs USING (patient_id)", *COHORT_VIEWS, "fx_labs"))
def cohort_labs(study: Study) -> DataFrame:
    """Cohort joined to the wide lab table, without the marker, the encounter column, dates and sign counts."""
    joined = co.inner(fr.with_constant(cohort_ids(study), "member", 1), study.labs(), "patient_id")
    features = fr.slice_columns(joined, 2, key="patient_id")
    return fr.drop_matching(features, ["first", "last", "neg", "pos"])


_SIGNS = ", ".join(f"{lab}, {lab}_neg, {lab}_pos" for lab in LABS)


@query("cohort_labs_signs", with_views(
    f"{COHORT_CTES} SELECT patient_id, {_SIGNS} FROM fx_labs SEMI JOIN fx_ids USING (patient_id)", *COHORT_VIEWS, "fx_labs"))
def cohort_labs_signs(study: Study) -> DataFrame:
    """The semi-join form, dropping dates only."""
    kept = co.left_semi(study.labs(), cohort_ids(study), "patient_id")
    return fr.drop_matching(fr.slice_columns(kept, 1, key="patient_id"), ["first", "last"])


@query("labs_present", with_views(
    "SELECT pat_id, order_id, line, result_date, result_value, result_flag FROM fx_lab_orders WHERE result_value IS NOT NULL", "fx_lab_orders"))
def labs_present(study: Study) -> DataFrame:
    return fr.where_present(study.lab_orders(), "result_value")


@query("labs_without_nan_key", with_views(
    "SELECT pat_id, result_value FROM fx_lab_orders WHERE result_value IS NOT NULL AND result_value = result_value", "fx_lab_orders"))
def labs_without_nan_key(study: Study) -> DataFrame:
    return fr.drop_nan_key(study.lab_orders().select("pat_id", "result_value"), "result_value")


@query("patients_many_encounters", with_views(
    "SELECT o_custkey AS patient_id, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_items FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 10"))
def patients_many_encounters(study: Study) -> DataFrame:
    visits = study.table("orders").select(F.col("o_custkey").alias("patient_id"), "o_orderkey")
    return fr.keys_with_more(visits, "patient_id", "o_orderkey", 10)


@query("encounters_many_codes", with_views(
    "SELECT encounter_id, patient_id, CAST(len(diagnosis_id) AS INTEGER) AS n_codes FROM fx_encounter WHERE len(diagnosis_id) > 1", "fx_encounter"))
def encounters_many_codes(study: Study) -> DataFrame:
    return fr.where_longer(study.encounters(), "diagnosis_id", 1).select("encounter_id", "patient_id", F.size("diagnosis_id").alias("n_codes"))


@query("point_lookup", with_views("SELECT pat_id, order_id, line, result_value FROM fx_lab_orders WHERE pat_id = 100", "fx_lab_orders"))
def point_lookup(study: Study) -> DataFrame:
    return fr.point_lookup(study.lab_orders(), "pat_id", 100).select("pat_id", "order_id", "line", "result_value")


_ORDER = "result_date, order_id, line"


@query("first_non_null", with_views(
    "SELECT pat_id, "
    f"min({{'d': result_date, 'o': order_id, 'l': line, 'v': result_value}}) FILTER (WHERE result_value IS NOT NULL).v AS result_value, "
    f"min({{'d': result_date, 'o': order_id, 'l': line, 'v': result_flag}}) FILTER (WHERE result_flag IS NOT NULL).v AS result_flag "
    "FROM fx_lab_orders GROUP BY pat_id", "fx_lab_orders").replace(").v AS", ")['v'] AS"))
def first_non_null(study: Study) -> DataFrame:
    first = fr.first_non_null(study.lab_orders(), "pat_id", ["result_date", "order_id", "line"])
    return first.select("pat_id", "result_value", "result_flag")


@query("labs_listed", with_views(f"SELECT patient_id, {', '.join(LABS[:5])} FROM fx_labs", "fx_labs"))
def labs_listed(study: Study) -> DataFrame:
    return fr.select_listed(study.labs(), LABS[:5], key="patient_id")


@query("labs_renamed", with_views("SELECT patient_id AS subject, lab_Brand1 AS first_lab FROM fx_labs", "fx_labs"))
def labs_renamed(study: Study) -> DataFrame:
    return fr.rename(fr.select(study.labs(), ["patient_id", "lab_Brand1"]), {"patient_id": "subject", "lab_Brand1": "first_lab"})


@query("labs_shape", with_views("SELECT count(*) AS n_rows, 126 AS n_columns FROM fx_labs", "fx_labs").replace("count(*)", "CAST(count(*) AS BIGINT)"))
def labs_shape(study: Study) -> DataFrame:
    return fr.shape(fr.slice_columns(study.labs(), 1, key="patient_id"))


@query("orders_deduplicated_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def orders_deduplicated_columns(study: Study) -> DataFrame:
    orders = study.table("orders")
    doubled = orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_custkey"))
    return fr.dedup_columns(doubled)


@query("patient_documents", with_views(
    "SELECT patient_id, '{' || " + " || ',' || ".join(f"'\"{d}\":' || {d}" for d in DIAGNOSES) + " || '}' AS doc FROM fx_diag", "fx_diag"))
def patient_documents(study: Study) -> DataFrame:
    return fr.to_documents(study.diagnoses(), "patient_id")


@query("composite_keys", "SELECT p_partkey, concat(p_type, p_partkey) AS plain, p_type || '|' || p_partkey AS separated FROM part")
def composite_keys(study: Study) -> DataFrame:
    parts = fr.with_key(study.table("part"), "plain", ["p_type", "p_partkey"])
    return fr.with_key(parts, "separated", ["p_type", "p_partkey"], sep="|").select("p_partkey", "plain", "separated")


@query("cluster_one_members", with_views("SELECT patient_id FROM fx_groups WHERE cluster = 1", "fx_groups"))
def cluster_one_members(study: Study) -> DataFrame:
    return fr.cluster_members(study.groups(), 1, "patient_id")


@query("diagnosed_both", with_views("SELECT patient_id, dx_urgent, dx_low FROM fx_diag WHERE dx_urgent = 1 AND dx_low = 1", "fx_diag"))
def diagnosed_both(study: Study) -> DataFrame:
    return fr.where_all_flags(study.diagnoses(), ["dx_urgent", "dx_low"]).select("patient_id", "dx_urgent", "dx_low")


@query("diagnosed_one", with_views("SELECT patient_id, dx_urgent FROM fx_diag WHERE dx_urgent = 1", "fx_diag"))
def diagnosed_one(study: Study) -> DataFrame:
    return fr.where_flag(study.diagnoses(), "dx_urgent").select("patient_id", "dx_urgent")


@query("first_record", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1")
def first_record(study: Study) -> DataFrame:
    return fr.first_record(study.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("row_cap", with_views("SELECT CAST(count(*) AS BIGINT) AS n_rows FROM fx_lab_orders", "fx_lab_orders"))
def row_cap(study: Study) -> DataFrame:
    """The rows a capped local copy would have had to hold: all of them, since nothing leaves Spark."""
    return study.lab_orders().agg(F.count("*").alias("n_rows"))


@query("preview", with_views("SELECT CAST(least(count(*), 5) AS BIGINT) AS n_rows FROM fx_lab_orders", "fx_lab_orders"))
def preview(study: Study) -> DataFrame:
    return fr.head(study.lab_orders(), 5).agg(F.count("*").alias("n_rows"))


@query("parquet_round_trip", with_views("SELECT patient_id, cluster FROM fx_groups", "fx_groups"))
def parquet_round_trip(study: Study) -> DataFrame:
    """Clusters written as one partitioned table in a single pass, replaced once, and read back."""
    path = scratch_path(study.spark, "groups")
    tb.write_parquet(study.groups(), path)
    tb.write_parquet(study.groups(), path, mode="overwrite", partition_by=["cluster"])
    return tb.read_parquet(study.spark, path).select("patient_id", F.col("cluster").cast("int").alias("cluster"))


@query("replaced_round_trip", with_views("SELECT patient_id, cluster FROM fx_groups", "fx_groups"))
def replaced_round_trip(study: Study) -> DataFrame:
    """Clusters in the place of an older version of them."""
    path = scratch_path(study.spark, "replaced")
    tb.replace_parquet(study.groups().where("cluster = 0"), path)
    tb.replace_parquet(study.groups(), path)
    return tb.read_replaced(study.spark, path).select("patient_id", "cluster")


@query("keyed_json_round_trip", with_views("SELECT CAST(event_id AS VARCHAR) AS key, doc FROM fx_docs", "fx_docs").replace("doc FROM fx_docs", "replace(doc, ': ', ':') AS doc FROM fx_docs"))
def keyed_json_round_trip(study: Study) -> DataFrame:
    path = scratch_path(study.spark, "keyed")
    tb.write_keyed_lines(study.documents(), path, "event_id")
    back = tb.read_keyed_json(study.spark, path)
    return back.select("key", F.replace("doc", F.lit(": "), F.lit(":")).alias("doc"))


@query("keyed_json_objects", with_views("SELECT CAST(event_id AS VARCHAR) AS key, doc FROM fx_docs", "fx_docs").replace("doc FROM fx_docs", "replace(doc, ': ', ':') AS doc FROM fx_docs"))
def keyed_json_objects(study: Study) -> DataFrame:
    """The same from whole objects, with line breaks between records."""
    path = scratch_path(study.spark, "objects")
    write_keyed_object(study.documents(), path, "event_id")
    back = tb.read_keyed_json(study.spark, path, form="object")
    return back.select("key", F.replace("doc", F.lit(": "), F.lit(":")).alias("doc"))


_DECIMAL = "regexp_replace(CAST(CAST({x} AS DECIMAL(38, 2)) AS VARCHAR), '0$', '')"


@query("price_text_cells", f"SELECT o_orderkey, {_DECIMAL.format(x='o_totalprice')} || ', ' || {_DECIMAL.format(x='o_custkey')} AS cells, "
       "o_totalprice AS price, o_custkey::DOUBLE AS buyer FROM orders")
def price_text_cells(study: Study) -> DataFrame:
    """Numbers joined into a text cell and split again."""
    cells = study.table("orders").select("o_orderkey", join_numbers([F.col("o_totalprice"), F.col("o_custkey")]).alias("cells"))
    price, buyer = split_numbers(F.col("cells"), 2)
    return cells.select("o_orderkey", "cells", price.alias("price"), buyer.alias("buyer"))
