"""Study inputs derived from the star-schema tables (see FIXTURES.md).

Each view exists twice: as a DataFrame for the engine and as SQL text for the
cross-check. Both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The brands of the part table, without the hash sign.
BRANDS = [f"Brand{i}" for i in range(1, 26)]
LABS = [f"lab_{b}" for b in BRANDS]
HIGH = 45

DIAGNOSES = ["dx_urgent", "dx_low", "dx_o", "dx_f", "dx_p"]


class Study:
    """The inputs of one study, read from a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def cohort(self) -> DataFrame:
        return self.table("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("patient_id"))

    def dx_map(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("dx_id"),
            F.col("p_type").alias("instance"),
            F.when(F.col("p_size") <= 3, True).when(F.col("p_size") <= 40, False).alias("flag"),
        )

    def _lines(self) -> DataFrame:
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    def problems(self) -> DataFrame:
        return self._lines().where("l_returnflag = 'R'").select(
            F.col("o_custkey").alias("patient_id"),
            F.concat("p_type", F.col("p_partkey").cast("string")).alias("diagnosis_id"),
        )

    def encounters(self) -> DataFrame:
        """One row per visit line with a short array of codes, at times empty or null."""
        codes = F.array(
            F.concat("p_type", F.col("p_partkey").cast("string")), F.concat("p_type", F.col("l_suppkey").cast("string"))
        )
        return self._lines().where("l_returnflag <> 'R'").select(
            F.col("o_orderkey").alias("encounter_id"),
            F.col("o_custkey").alias("patient_id"),
            F.col("o_orderdate").cast("date").alias("visit_date"),
            F.when(F.col("l_quantity") < 3, None)
            .when(F.col("l_quantity") < 5, F.array().cast("array<string>"))
            .otherwise(codes)
            .alias("diagnosis_id"),
        )

    def labs(self) -> DataFrame:
        """One row per patient: encounter count, then five columns per lab. Unused ones are pruned by the optimizer.

        Short lines meet at their patient first: counted before that, nearly every line would become a wide row of its own in memory.
        Encounters are counted by the first line of each, so that no wide rows are held per order either.
        """
        lines = self._lines().select(
            F.col("o_custkey").alias("patient_id"), "o_orderkey", F.col("l_quantity").alias("q"),
            F.col("l_shipdate").cast("date").alias("d"), F.col("p_brand").alias("b"),
        ).repartition("patient_id")
        lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy("patient_id", "o_orderkey").orderBy("o_orderkey")))
        columns = ["count_if(nth = 1) AS n_encounters"]
        for brand, lab in zip(BRANDS, LABS):
            q, d = (f"CASE WHEN b = '{brand.replace('Brand', 'Brand#')}' THEN {c} END" for c in ("q", "d"))
            columns += [
                f"CASE WHEN max({q}) >= {HIGH} THEN 1 WHEN max({q}) < {HIGH} THEN 0 END AS {lab}",
                f"min({d}) AS {lab}_first",
                f"max({d}) AS {lab}_last",
                f"count_if(({q}) < {HIGH}) AS {lab}_neg",
                f"count_if(({q}) >= {HIGH}) AS {lab}_pos",
            ]
        return lines.groupBy("patient_id").agg(*[F.expr(c) for c in columns])

    def lab_orders(self) -> DataFrame:
        return self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("pat_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_shipdate").cast("date").alias("result_date"),
            F.when(F.col("l_discount") >= 0.03, F.col("l_extendedprice")).alias("result_value"),
            F.when(F.col("l_tax") >= 0.04, F.col("l_linestatus")).alias("result_flag"),
        )

    def diagnoses(self) -> DataFrame:
        def at_least(condition: str, n: int, name: str):
            return F.when(F.count_if(F.expr(condition)) >= n, 1).otherwise(0).alias(name)

        return self.table("orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(
            at_least("o_orderpriority = '1-URGENT'", 3, "dx_urgent"),
            at_least("o_orderpriority = '5-LOW'", 3, "dx_low"),
            at_least("o_orderstatus = 'O'", 3, "dx_o"),
            at_least("o_orderstatus = 'F'", 3, "dx_f"),
            at_least("o_orderstatus = 'P'", 3, "dx_p"),
        )

    def groups(self) -> DataFrame:
        """A fixed split, so that screens and overlays have an exact answer."""
        return self.table("customer").select(
            F.col("c_custkey").alias("patient_id"), F.when(F.col("c_acctbal") >= 4500, 1).otherwise(0).alias("cluster")
        )

    def points(self) -> DataFrame:
        vector = F.transform("embedding", lambda x: x.cast("double"))
        return self.table("embeddings").select(F.col("vec_id").alias("id"), vector.alias("vec"), F.col("label").alias("cluster"))

    def documents(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("props").alias("doc"))


def _lab_sql(brand: str, lab: str) -> str:
    q = f"CASE WHEN b = '{brand}' THEN q END"
    d = f"CASE WHEN b = '{brand}' THEN d END"
    return (
        f"CASE WHEN max({q}) >= {HIGH} THEN 1 WHEN max({q}) < {HIGH} THEN 0 END AS {lab}, "
        f"min({d}) AS {lab}_first, max({d}) AS {lab}_last, "
        f"CAST(coalesce(sum(CASE WHEN ({q}) < {HIGH} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {lab}_neg, "
        f"CAST(coalesce(sum(CASE WHEN ({q}) >= {HIGH} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {lab}_pos"
    )


def _dx_sql(condition: str, name: str) -> str:
    return f"CASE WHEN sum(CASE WHEN {condition} THEN 1 ELSE 0 END) >= 3 THEN 1 ELSE 0 END AS {name}"


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"

VIEW_SQL: dict[str, str] = {
    "fx_cohort": "SELECT c_custkey AS patient_id FROM customer WHERE c_acctbal >= 0",
    "fx_dx_map": (
        "SELECT p_partkey AS dx_id, p_type AS instance, concat(p_type, p_partkey) AS diagnosis_id, "
        "CASE WHEN p_size <= 3 THEN true WHEN p_size <= 40 THEN false END AS flag FROM part"
    ),
    "fx_problem": f"SELECT o_custkey AS patient_id, concat(p_type, p_partkey) AS diagnosis_id FROM {_LINES} WHERE l_returnflag = 'R'",
    "fx_encounter": (
        "SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS visit_date, "
        "CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 5 THEN CAST([] AS VARCHAR[]) "
        "ELSE [concat(p_type, p_partkey), concat(p_type, l_suppkey)] END AS diagnosis_id "
        f"FROM {_LINES} WHERE l_returnflag <> 'R'"
    ),
    "fx_labs": (
        "SELECT patient_id, count(DISTINCT o_orderkey) AS n_encounters, "
        + ", ".join(_lab_sql(b, lab) for b, lab in zip(BRANDS, LABS))
        + " FROM (SELECT o_custkey AS patient_id, o_orderkey, l_quantity AS q, CAST(l_shipdate AS DATE) AS d, "
        f"replace(p_brand, '#', '') AS b FROM {_LINES}) GROUP BY patient_id"
    ),
    "fx_lab_orders": (
        "SELECT o_custkey AS pat_id, l_orderkey AS order_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS result_date, "
        "CASE WHEN l_discount >= 0.03 THEN l_extendedprice END AS result_value, "
        "CASE WHEN l_tax >= 0.04 THEN l_linestatus END AS result_flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ),
    "fx_diag": (
        "SELECT o_custkey AS patient_id, "
        + ", ".join(
            _dx_sql(c, n)
            for c, n in [
                ("o_orderpriority = '1-URGENT'", "dx_urgent"),
                ("o_orderpriority = '5-LOW'", "dx_low"),
                ("o_orderstatus = 'O'", "dx_o"),
                ("o_orderstatus = 'F'", "dx_f"),
                ("o_orderstatus = 'P'", "dx_p"),
            ]
        )
        + " FROM orders GROUP BY o_custkey"
    ),
    "fx_groups": "SELECT c_custkey AS patient_id, CASE WHEN c_acctbal >= 4500 THEN 1 ELSE 0 END AS cluster FROM customer",
    "fx_points": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster FROM embeddings",
    "fx_docs": "SELECT event_id, props AS doc FROM events",
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """A statement with the named views in front; ``body`` starts with SELECT or with a further CTE list."""
    word = "WITH RECURSIVE" if recursive else "WITH"
    body = body.removeprefix("WITH ") if body.startswith("WITH ") else body
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    if body.startswith("SELECT"):
        return f"{word} {ctes} {body}" if ctes else body
    return f"{word} {ctes}, {body}" if ctes else f"{word} {body}"
