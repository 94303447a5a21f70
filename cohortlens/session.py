"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cohortlens", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with adaptive execution on; further settings come as ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for name, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which the driver and all executors reach.

    A plain local session without the setting gets a temporary folder, once. Any other must set it: on a
    cluster a machine-local path would vanish with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="cohortlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/cohortlens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is read several times (iterations, fits). It cuts
    lineage, survives executor loss, and gives later plans file statistics.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, table: DataFrame | str) -> None:
    """Remove the files of a table written by :func:`materialize`, or a path below the shared folder, that nothing reads any more."""
    if not isinstance(table, str):
        files = table.inputFiles()
        if not files:
            return
        table = files[0].rpartition("/")[0]
    if f"{shared_dir(spark).partition(':')[2] or shared_dir(spark)}/cohortlens/" not in table:
        raise ValueError(f"{table} is no scratch table")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
