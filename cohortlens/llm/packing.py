"""Packing of token pieces into sequences of bounded length by the sum-of-squares rule."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.tokens import token_pieces
from cohortlens.session import materialize

# Pieces packed together in one task; open sequences of different tasks are never merged.
PIECES_PER_TASK = 1 << 17


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, placed in the order given.

    ``open_at[g]`` counts the open bins with gap ``g``. A size ``s`` goes to the gap, or to a new bin, that
    makes the sum of squares of these counts smallest: using a gap ``g`` changes it by
    ``2 (open_at[g - s] - open_at[g] + 1)``, a new bin by ``2 open_at[capacity - s] + 1``; full bins do not
    count. Ties go to the smaller gap, and to an open bin before a new one. A size of the whole capacity
    is a bin of its own; larger sizes are an error.
    """
    if len(sizes) and (sizes.max() > capacity or sizes.min() < 1):
        raise ValueError("sizes must be between 1 and the capacity")
    open_at = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), 0
    never = np.int64(1) << 60
    for i, s in enumerate(sizes.tolist()):
        gap = capacity
        if s < capacity:
            there = open_at[s:capacity]
            change = 2 * (open_at[: capacity - s] - there + 1)
            change[0] = 1 - 2 * there[0]  # fills the bin: nothing is left open
            change[there == 0] = never
            best = int(change.argmin())
            if change[best] <= 2 * open_at[capacity - s] + 1:
                gap = s + best
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            open_at[gap] -= 1
            bin_ = stacks[gap].pop()
        bins[i], offsets[i] = bin_, capacity - gap
        if 0 < gap - s:
            open_at[gap - s] += 1
            stacks[gap - s].append(bin_)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, size: str = "length", per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``size`` between 1 and ``capacity``.

    Rows are dealt by hash into groups of about ``per_task`` and packed there, the longest first and equal lengths in the
    order of their other columns, so a task's work is bounded, every group sees the same mix of sizes, and the
    packing does not depend on the order in which rows arrive. Within a sequence offsets leave no gap.
    Groups of at least tens of thousands of rows lose less than one sequence in a thousand
    by being packed apart. ``pieces`` is read twice: hand in a stored table. Repeated rows are packed each on
    their own. An empty table gives an empty result.
    """
    parts = max(1, math.ceil(pieces.count() / per_task))
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]
    ties = [f.name for f in fields if f.name != size and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(group: pa.Table) -> pa.Table:
        number = group.column("__group")[0].as_py()
        own = group.select(names).sort_by([(size, "descending"), *[(n, "ascending") for n in ties]])
        bins, offsets = sum_of_squares(own.column(size).to_numpy(), capacity)
        return own.append_column("sequence_id", pa.array(bins + (np.int64(number) << 32))).append_column("offset", pa.array(offsets))

    group = F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")
    return pieces.select(*names, group.alias("__group")).groupBy("__group").applyInArrow(place, schema)


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1, path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Tokenize whole texts and pack them: ``key, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Only documents longer than a sequence are cut. The pieces (without ids, a few dozen bytes each) are stored once
    between the two steps, so texts are tokenized once. A null or empty text is one piece of the ``end`` id alone; repeated
    rows give repeated pieces, each with a place of its own; a row without a key is packed like any other; an empty
    table gives an empty result. Further columns of the input play no part.
    """
    pieces = token_pieces(docs, key, text, capacity, end, path, with_ids)
    return pack(materialize(pieces, "pieces"), capacity)
