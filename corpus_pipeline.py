"""From raw documents to packed sequences: the corpus operators one after the other.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``, except the last, which returns the packing. Rows of the first four stages are whole documents;
only line dedup changes their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import linededup, minhash, packing, quality, toxicity
from cohortlens.llm.registry import table
from cohortlens.session import materialize

TOXIC_FROM, GOOD_FROM = 0.7, 0.5


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC_FROM``.

    A null or empty text has the score of no terms, the bias that the labels give. Repeated rows, rows without an id and very
    long texts, scored whole, are judged like any other; without labels every score is 0.5 and all stay.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(machine, docs["text"]) < TOXIC_FROM)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least ``GOOD_FROM``.

    A null or empty text has the score of the bias alone. Repeated rows, rows without an id and very long texts, scored
    whole, are judged like any other; without labels every score is 0.5 and all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, docs["text"]) >= GOOD_FROM)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stood earlier; one of which nothing but white space remains goes as well."""
    cut = linededup.dedup_lines(docs)
    return cut.where((F.col("lines_deleted") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows that repeat a kept id all stay: they are told apart by nothing.
    """
    found = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, docs["doc_id"] == found["__id"], "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 4096.

    A null or empty text is one piece, the end id alone; a very long one is cut; repeated rows and rows without an id
    have pieces of their own; no document gives no row.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("quality", good),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("packing", packed),
]

# No stage but the fourth can be said in SQL; tests/llm checks the stages against direct computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
