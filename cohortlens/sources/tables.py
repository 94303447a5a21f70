"""Tables, Parquet, text reports and keyed JSON."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.keyed_json import read_keyed_object

# Names the current version of a result; readers of whole folders pass over names that begin like this.
_POINTER = "_current"


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a catalog table or view, all columns or the listed ones."""
    df = spark.table(name)
    return df.select(*columns) if columns else df


def query_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The SQL form of :func:`read_table`, with names bound as parameters rather than pasted in."""
    if not columns:
        return spark.sql("SELECT * FROM IDENTIFIER(:t)", args={"t": name})
    marks = ", ".join(f"IDENTIFIER(:c{i})" for i in range(len(columns)))
    args = {f"c{i}": c for i, c in enumerate(columns)}
    return spark.sql(f"SELECT {marks} FROM IDENTIFIER(:t)", args={"t": name, **args})


def register(df: DataFrame, name: str) -> DataFrame:
    """Give ``df`` a name that SQL in this session can use."""
    df.createOrReplaceTempView(name)
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write Parquet. The default refuses an existing target; ``overwrite`` replaces it."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Put a new version of a result in the place of the old one, which stays readable until the new one is complete.

    The version is written beside the others below ``path``; a pointer file then names it, put in place by one rename, and older
    versions go. A job that ends before that leaves the old result as it was. ``df`` may read the old version. One
    writer at a time. Read with :func:`read_replaced`.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    files, root = _file_system(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    fresh = hadoop.fs.Path(root, f"_{version}")
    out = files.create(fresh, True)
    out.write(version.encode())
    out.close()
    # Unlike a plain rename this one may replace a file, and does so at once.
    overwrite = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    overwrite[0] = hadoop.fs.Options.Rename.OVERWRITE
    hadoop.fs.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, hadoop.fs.Path(root, _POINTER), overwrite)
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.lstrip("_").startswith("version-") and name != version:
            files.delete(status.getPath(), True)


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a result written by :func:`replace_parquet`; an error if there is none yet."""
    files, root = _file_system(spark, path)
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, _POINTER)
    if not files.exists(pointer):
        raise FileNotFoundError(f"no complete version in {path}")
    stream = files.open(pointer)
    version = bytes(stream.readAllBytes()).decode()
    stream.close()
    return spark.read.parquet(f"{path}/{version}")


def _file_system(spark: SparkSession, path: str):
    """The store of a path, and the path in it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(root)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a flat frame (for example a wide fingerprint table) as tab-separated text."""
    df.write.mode(mode).option("sep", "\t").option("header", False).csv(path)


def write_keyed_lines(docs: DataFrame, path: str, key: str, doc: str = "doc") -> None:
    """Write documents as lines of ``{"<key>": <document>}``."""
    line = F.concat(F.lit("{"), _json_key(F.col(key)), F.lit(":"), F.col(doc), F.lit("}"))
    docs.select(line.alias("value")).write.text(path)


def _json_key(col):
    quoted = F.to_json(F.array(col.cast("string")))
    return quoted.substr(F.lit(2), F.length(quoted) - 2)


def read_keyed_json(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """Read ``{key: {..record..}}`` JSON as ``(key, doc)`` rows, ``doc`` being JSON text.

    In the form ``lines`` each line is one such object with one or more records, so files of any size split; blank lines
    play no part, and a line that is no such object fails the job. In the form ``object`` a file is one such object, with
    line breaks anywhere (:func:`read_keyed_object`).
    """
    if form == "object":
        return read_keyed_object(spark, path)
    if form != "lines":
        raise ValueError(f"unknown form {form!r}")
    records = F.map_entries(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}))
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.explode(records).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("doc"))
