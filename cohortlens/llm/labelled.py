"""What the two text classifiers share: the split by document id and a bounded sample of labelled texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled documents a classifier is fitted on, at most.
FIT_ROWS = 8000


def held_out(key: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves remainder 1 by three; such rows' labels are never learned."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(3)) == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, label)`` of at most ``rows`` labelled documents outside the held-out third.

    The rows with the smallest hash of their id are taken, so the sample neither depends on partitioning nor
    favours a source. Rows without an id, a 0/1 label or any text are left out; an id that has several labels
    or texts takes part with the smallest of them.
    """
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out("key")).groupBy("key").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text")).where(F.length("text") > 0)
    # At most ``rows`` short rows: small enough to send to every task, whatever the tables' size.
    return texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"))


class Sample:
    """A collected sample of labels and packed numbers, read where Arrow holds it, in an order of its content; copies count once."""

    def __init__(self, rows: DataFrame, packed: list[str], label: str = "label"):
        table = rows.select(label, *packed).toArrow().combine_chunks()
        self.columns = []
        for name in packed:
            chunks = table[name].chunks
            whole = pa.concat_arrays(chunks).cast(pa.large_binary()) if chunks else pa.array([], pa.large_binary())
            ends = np.frombuffer(whole.buffers()[1], dtype=np.int64) if len(whole) else np.zeros(1, dtype=np.int64)
            data = np.frombuffer(whole.buffers()[2], dtype=np.uint8) if len(whole) and whole.buffers()[2] else np.zeros(0, dtype=np.uint8)
            self.columns.append((whole, ends, data))
        labels = table[label].to_numpy().astype(int)
        seen = {}
        for i in range(len(labels)):
            seen.setdefault(xxhash.xxh3_128_digest(b"".join([bytes([labels[i]]), *(self.bytes(c, i) for c in range(len(packed)))])), i)
        self.order = [seen[k] for k in sorted(seen)]
        self.labels = labels[self.order]

    def bytes(self, column: int, row: int) -> np.ndarray:
        _, ends, data = self.columns[column]
        return data[ends[row] : ends[row + 1]]

    def numbers(self, column: int, i: int, dtype: str) -> np.ndarray:
        return self.bytes(column, self.order[i]).view(dtype)

    def __len__(self) -> int:
        return len(self.order)
