"""What each filter of a chain removes, for every order in which the chain could run."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import pick

# Most filters of a chain: the result has a row per order, n! of them, and step.
MOST_FILTERS = 7


def lehmer_rank(order: Sequence[int]) -> int:
    """Place of a permutation of ``0 .. n-1`` among all of them in lexicographic order."""
    rank = 0
    for i, x in enumerate(order):
        rank = rank * (len(order) - i) + sum(y < x for y in order[i + 1 :])
    return rank


def intervals(mask: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """``(step, filter, start, stop)``: in the orders of rank ``start .. stop - 1`` a row with these failures goes at ``step`` by ``filter``.

    A row that fails the filters of ``mask`` goes at step ``s`` wherever the first ``s - 1`` filters are ones it
    passes and the next one it fails. All orders that begin alike are neighbours in lexicographic order, so
    each such beginning is one interval of ``(n - s)!`` ranks that begins at the rank of its least order.
    """
    passed = [f for f in range(n) if not mask >> f & 1]
    failed = [f for f in range(n) if mask >> f & 1]
    for step in range(1, len(passed) + 2 if failed else 1):
        for before in itertools.permutations(passed, step - 1):
            for f in failed:
                head = (*before, f)
                start = lehmer_rank((*head, *(x for x in range(n) if x not in head)))
                yield step, f, start, start + math.factorial(n - step)


def removals(masks: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """``[rank, step - 1, weight]``: what each order removes at each step, from a few masks with weights.

    Every mask adds its weights where one of its intervals begins and takes them off where it ends; running
    sums over the ranks then give the totals of all orders at once.
    """
    change = np.zeros((math.factorial(n) + 1, n, weights.shape[1]), dtype=np.int64)
    for mask, own in zip(masks.tolist(), weights):
        for step, _, start, stop in intervals(mask, n):
            change[start, step - 1] += own
            change[stop, step - 1] -= own
    return change.cumsum(axis=0)[:-1]


def audit(rows: DataFrame, filters: Sequence[str], part: str, good: str, toxic: str, rows_each: str | None = None) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    ``filters`` names boolean columns, true where a row fails; each is known by the first letter of its name, so
    these must differ. ``filter_order`` spells an order, of which there are ``n!``, in lexicographic order of the filters as
    given; ``step`` is 1 to ``n``, and its filter the letter there. Counts are within the ``part``: ``removed`` at this
    step, ``kept`` after it, ``redundant`` failing this filter but removed earlier, ``unique_fails`` failing this
    filter alone, ``good_lost`` and ``toxic_lost`` of the removed those with ``good`` or ``toxic``, and ``shapley`` what the filter
    removes over all orders together. ``rows_each`` is how many rows a row stands for (1 if not given).

    Rows are first counted by part and failures, at most ``2^n`` short rows a part whatever the size of the
    part, merged before the shuffle; the orders are worked out from those. A null flag counts as passed or as false,
    a null part is the part of the empty string, an empty table gives an empty result.
    """
    n = len(filters)
    letters = [f[0] for f in filters]
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different first letters")

    def true(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("boolean"), F.lit(False))

    mask = sum((F.when(true(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    each = F.col(rows_each).cast("long") if rows_each else F.lit(1).cast("long")
    counted = rows.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask")).agg(
        F.sum(each).alias("n"), F.sum(F.when(true(good), each).otherwise(0)).alias("good"), F.sum(F.when(true(toxic), each).otherwise(0)).alias("toxic")
    )
    orders = list(itertools.permutations(range(n)))  # in lexicographic order: the place of an order is its rank
    names = ["".join(letters[f] for f in order) for order in orders]
    filter_at = np.array(orders)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def all_orders(pdf: pd.DataFrame) -> pd.DataFrame:
        masks, weights = pdf["mask"].to_numpy(), pdf[["n", "good", "toxic"]].to_numpy()
        gone = removals(masks, weights, n)
        removed, rows_in = gone[:, :, 0], weights[:, 0].sum()
        fails = np.array([weights[masks >> f & 1 == 1, 0].sum() for f in range(n)])
        alone = np.array([weights[masks == 1 << f, 0].sum() for f in range(n)])
        over_orders = np.bincount(filter_at.ravel(), removed.ravel(), n).astype(np.int64)
        return pd.DataFrame({
            "part": pdf["part"].iloc[0], "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
            "kept": (rows_in - removed.cumsum(axis=1)).ravel(), "removed": removed.ravel(), "redundant": (fails[filter_at] - removed).ravel(),
            "unique_fails": alone[filter_at].ravel(), "good_lost": gone[:, :, 1].ravel(), "toxic_lost": gone[:, :, 2].ravel(),
            "shapley": over_orders[filter_at].ravel(),
        })

    return counted.groupBy("part").applyInPandas(all_orders, schema)


# --- the five filters of a document ------------------------------------------------------

# The conditions of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
_CAPITALS, _CONTINUED = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))


def text_failures(data: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a text in UTF-8 fails filters A to D: too short, too repetitive, too many capitals, a mark of :data:`MARKS`.

    ``bytes.split`` parts words at exactly the six white-space characters of ASCII.
    """
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _CONTINUED))
    return (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * points,
        len(data.translate(None, MARKS)) < len(data),
    )


def document_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(key, part, digest, A, B, C, D)``: failures of filters A to D by whole texts, and the text's SHA-256. A null text is empty."""
    rows = pick(docs, key=key, text=text, part=part)
    rows = rows.select("key", F.col("part").cast("string").alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(3), "").cast(pa.large_binary())
            failed = [text_failures(t.as_py()) for t in texts]
            columns = [pa.array(c, pa.bool_()) for c in zip(*failed)] if failed else [pa.array([], pa.bool_())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["key", "part", "digest", *"ABCD"])

    return rows.mapInArrow(run, f"key {kind}, part string, digest binary, A boolean, B boolean, C boolean, D boolean")


def document_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """:func:`audit` of five filters on whole documents: A to D by their text, E the repeats of a text.

    E fails where a row with a smaller key has the same text anywhere in the table, removed or not. ``good`` is a document
    with a label ``quality`` of 1, ``toxic`` one with ``toxic`` of 1 (with several labels: in any of them).

    Only digests, flags and keys are shuffled, first by key to meet the labels and to count repeated rows, then by
    text. Rows of one text differ only in key, part and labels, so a text is a few counts, however many rows have
    it: of each kind its rows and those with its smallest key, merged before the shuffle. The text's smallest key of
    all is then known, and the rows that have it are those that pass E. A row without a key passes E and has no label.
    """
    marks = pick(labels, key=key, quality="quality", toxic="toxic").where("key IS NOT NULL").groupBy("key").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    kinds = ["digest", "part", *"ABCD", "good", "toxic"]
    rows = document_failures(docs.where(F.col(key).isNotNull()), key, text, part).join(marks, "key", "left")
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    keyed = rows.groupBy("key", *kinds).agg(F.count("*").alias("n"))
    texts = keyed.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("least"))
    # One text has at most one row for each part and pair of labels here.
    texts = texts.withColumn("first", F.min("least.key").over(Window.partitionBy("digest")))
    passing = F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), passing.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passing).alias("n"))))
    counted = texts.select("part", *"ABCD", "good", "toxic", both.alias("e")).select("part", *"ABCD", "e.E", "good", "toxic", "e.n").where("n > 0")
    # Rows without a key would all be one group above: they pass E anyway, and are counted apart.
    free = document_failures(docs.where(F.col(key).isNull()), key, text, part)
    free = free.select("part", *"ABCD", F.lit(False).alias("E"), F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return audit(counted.unionAll(free), list("ABCDE"), "part", "good", "toxic", "n")
