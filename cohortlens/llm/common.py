"""Helpers the operators of this subpackage share.

Every operator first takes the columns it needs with :func:`pick`, so further
columns of the input, whatever their names, never meet its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize

# Odd 64-bit multipliers of the splitmix64 finaliser and the golden ratio: fixed values.
MIX_1, MIX_2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given as keywords."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (splitmix64), the same on every machine."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
        return x ^ (x >> np.uint64(31))


def uniforms(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table written by :func:`materialize` that nothing reads any more.

    Best effort: a store without a client here keeps its files until the shared folder is emptied.
    """
    from pyarrow import fs

    with suppress(Exception):
        for file in df.inputFiles():
            where, path = fs.FileSystem.from_uri(file.replace("file:///", "/"))
            where.delete_file(path)


def one_each(files: DataFrame, order: str) -> DataFrame:
    """A stored list of files, a short row each, with a partition of its own for each row, which adaptive execution keeps."""
    numbered = files.withColumn("__place", (F.row_number().over(Window.orderBy(order)) - 1).cast("int"))
    return numbered.repartitionById(max(1, files.count()), F.col("__place")).drop("__place")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches sorted by the keys (no null keys), one table per run."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [np.asarray(table[k].to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(table.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for at, end in zip(starts, starts[1:]):
            own = tuple(c[at] for c in columns)
            if held and own != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(at, end - at))
            last = own
    if held:
        yield pa.concat_tables(held)


def in_blocks(df: DataFrame, rows: Column, block: int, key: Column) -> DataFrame:
    """Cut groups into blocks and repeat each row for every pair of blocks it takes part in.

    ``rows`` is the size of the row's group. A group of at most ``block`` rows stays whole, as pair
    (0, 0). A larger one is dealt by the hash of ``key`` into blocks that meet pair by pair in the
    groups ``(first, second)``; ``own`` tells which of the two a row belongs to. No task holds more
    than two blocks, and no pair of rows is ever written out.
    """
    parts = F.ceil(rows / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64(key), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    placed = df.withColumn("own", own).withColumn("other", other)
    return placed.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")}).drop("other")


_REMEMBERED: dict = {}


def remembered(name, make):
    """A table of a Python worker, kept from task to task; the table of another name takes its place.

    A worker serves one operator after the other, and so holds the table of one of them only.
    """
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        released()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def released() -> None:
    """Give memory that is no longer used back to the machine, which neither Arrow nor the C library does at once."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)


def forgetting(run):
    """``run`` over batches, for a Python worker that forgets its table and gives memory back when the task ends.

    A worker that idles in a later stage, or serves one of another kind, then holds nothing of this one.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _REMEMBERED.clear()
            released()

    return task


class Forest:
    """Groups of rows that links have joined so far, for a block of bounded size."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        """Join two groups; false if they were one already."""
        x, y = self.root[a], self.root[b]
        if x == y:
            return False
        self.root[self.root == max(x, y)] = min(x, y)
        return True


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)``: for every id in ``edges(a, b)`` the smallest id it is connected with.

    Alternating stars: each id sends its larger neighbours, then its smaller ones, to the smallest
    id it knows, until nothing changes; the number of rounds grows with the logarithm of the longest
    chain. Minima are merged before each shuffle, joins may be split by adaptive execution, every
    round is written to the shared folder and the one before it removed. Null ids and loops are ignored.
    """
    table = materialize(edges.select("a", "b").where("a <> b").distinct(), label)
    state = None
    while True:
        new_state = tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new_state == state or not new_state[0]:
            break
        state = new_state
        both = table.union(table.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = materialize(larger, label)
        low = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = low.groupBy("u").agg(F.min("v").alias("m"))
        smaller = low.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        fresh = materialize(smaller.union(root).distinct().toDF("a", "b"), label)
        drop_table(table)
        drop_table(stars)
        table = fresh
    # A star now: every id but the smallest points at the smallest.
    return table.union(table.select("b", "b")).groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
