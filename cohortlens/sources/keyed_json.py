"""One JSON object of records, ``{key: {..record..}, ...}``, in files of any size, read in parallel.

Spark's text reader cuts files into blocks and, at every comma, into pieces. What a piece means depends on all before it: whether it
stands within quotes, and how many braces are open. Each block tells, for either state at its beginning, the state at its end
and the change of depth; carried from block to block, one short row each, this gives every block its start. The
commas at depth one then part the records, and those that cross blocks are put together from their parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize

_BLANKS = b" \t\n\r"


def read_keyed_object(spark: SparkSession, path: str) -> DataFrame:
    """``(key, doc)``: the records of the one JSON object that each file under ``path`` holds, ``doc`` being JSON text.

    Line breaks may stand anywhere. A task reads a block of a file, whatever the size of the file; a record of any length is put together from
    the blocks that it crosses. Blocks' states, a short row each, pass through the driver. A file that is not one object fails the
    job with its name and the place; so does a record without a key or a value. Values are handed on as they stand, without
    a look inside. A repeated key gives a row for each time, an empty object none.
    """
    blocks = _blocks(spark, path).mapInArrow(_ends, "path string, block long, flips boolean, plain long, quoted long")
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    state: dict[str, tuple[bool, int]] = {}
    for row in blocks.orderBy("path", "block").collect():
        within, depth = starts[row.path, row.block] = state.get(row.path, (False, 0))
        state[row.path] = (within != row.flips, depth + (row.quoted if within else row.plain))
    for file, (within, depth) in state.items():
        if within or depth:
            raise ValueError(f"{file}: the object does not end ({depth} open{', within quotes' if within else ''})")
    parts = materialize(_blocks(spark, path).mapInArrow(_cut(starts), "path string, block long, place int, opener string, closer string, key string, text string"), "records")
    whole = parts.where("place = 1").select("key", F.col("text").alias("doc"))
    # Parts of records that cross blocks, at most two of a block: each belongs to the last one that begins before or with it.
    crossing = parts.where("place <> 1").withColumn("first", F.last(F.when(F.col("place") == 2, F.col("block")), ignorenulls=True).over(Window.partitionBy("path").orderBy("block", "place")))
    glued = crossing.groupBy("path", "first").agg(F.array_sort(F.collect_list(F.struct("block", "place", "opener", "closer", "text"))).alias("parts"))
    return whole.unionAll(glued.mapInArrow(_glue, "key string, doc string"))


def write_keyed_object(docs: DataFrame, path: str, key: str, doc: str = "doc") -> None:
    """Write documents (JSON text) as one object ``{"<key>": <document>, ...}`` for each partition, a record to a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = [f"{json.dumps(k)}: {d}" for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if lines:
                yield pa.RecordBatch.from_pydict({"value": [("{" if first and not i else ",") + line for i, line in enumerate(lines)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["{}" if first else "}"]})

    docs.select(F.col(key).cast("string"), F.col(doc)).mapInArrow(run, "value string").write.text(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between commas, in order within a block; a piece belongs to the block it begins in."""
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, bytes]]:
    """Consecutive text of a block, with commas put back: its key, whether it is the block's first, the bytes."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, numbers = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        codes = files.indices.to_numpy()
        starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (numbers[1:] != numbers[:-1])))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            own = (files.dictionary[int(codes[a])].as_py(), int(numbers[a]))
            # The comma before the first piece of a block ends the block before.
            yield own, own != last, b",".join(batch.column(2).slice(a, b - a).cast(pa.binary()).to_pylist()) + b","
            last = own


def _scan(text: bytes, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The bytes, the change of depth up to and with each, whether each stands outside of quotes, and the state at the end.

    No escape crosses a comma that parts pieces: within quotes a backslash before a comma is no JSON.
    """
    data = np.frombuffer(text, np.uint8)
    quote = data == ord('"')
    slash = data == ord("\\")
    if slash.any():
        at = np.arange(len(data))
        run = at - np.maximum.accumulate(np.where(slash, -1, at))  # backslashes up to and with each byte
        quote[1:] &= run[:-1] % 2 == 0
    inside = np.logical_xor.accumulate(np.append(within, quote))[1:]
    free = ~inside & ~quote
    step = (free & ((data == ord("{")) | (data == ord("[")))).astype(np.int64) - (free & ((data == ord("}")) | (data == ord("]"))))
    return data, np.cumsum(step), free, bool(inside[-1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: whether it turns the state of the quotes, and its change of depth if it begins outside of and within them."""
    own, flips, depth = None, False, [0, 0]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [own[0]], "block": [own[1]], "flips": [flips], "plain": [depth[0]], "quoted": [depth[1]]})

    for key, first, text in _runs(batches):
        if first:
            if own is not None:
                yield told()
            own, flips, depth = key, False, [0, 0]
        changes = [_scan(text, start) for start in (False, True)]
        for begin in (0, 1):
            depth[begin] += int(changes[begin != flips][1][-1])
        flips = flips != changes[0][3]
    if own is not None:
        yield told()


def _cut(starts: dict[tuple[str, int], tuple[bool, int]]):
    """Records within a block (``place`` 1), and what of a record goes on from the block before (0) or into the next (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, within, depth, opener, held, rows = None, False, 0, None, [], []

        def rest() -> tuple:
            # The comma after the last piece of a file is not there: it stands after the closing brace and is blank's equal.
            return (*own, 0 if opener is None else 2, opener, None, None, b"".join(held))

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names=["path", "block", "place", "opener", "closer", "key", "text"])

        for key, first, text in _runs(batches):
            if first:
                if own is not None:
                    rows.append(rest())
                own, held = key, []
                within, depth = starts[key]
                opener = "start" if key[1] == 0 else None
            data, change, free, now = _scan(text, within)
            after = depth + change
            if after.min() < 0:
                raise ValueError(f"{key[0]}: a brace too many in the block at byte {key[1]}")
            before = np.append(depth, after[:-1])
            outer = ((data == ord("{")) & (before == 0) & (after == 1)) | ((data == ord("}")) & (before == 1) & (after == 0)) | ((data == ord(",")) & (before == 1) & (after == 1))
            if (free & (data == ord("[")) & (before == 0)).any():
                raise ValueError(f"{key[0]}: an array where the object should be, in the block at byte {key[1]}")
            at = 0
            for mark in np.flatnonzero(free & outer).tolist():
                held.append(text[at:mark])
                part, closer = b"".join(held), chr(data[mark])
                if opener is None:
                    rows.append((*own, 0, None, closer, None, part))
                else:
                    record = _record(key[0], opener, closer, part)
                    if record:
                        rows.append((*own, 1, None, None, record[0], record[1].encode()))
                opener, held, at = closer, [], mark + 1
            held.append(text[at:])
            within, depth = now, int(after[-1])
            if len(rows) >= 4096:
                yield made()
                rows = []
        if own is not None:
            rows.append(rest())
        if rows:
            yield made()

    return run


def _glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for file, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            found.append(_record(file, parts[0]["opener"], parts[-1]["closer"], "".join(p["text"] for p in parts).encode()))
        found = [r for r in found if r]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string())], names=["key", "doc"])


def _record(file: str, opener: str, closer: str | None, text: bytes) -> tuple[str, str] | None:
    """Key and document of what stands between two marks at depth one, or nothing where nothing has to stand."""
    body = text.strip(_BLANKS)
    if opener in ("start", "}"):
        # Before and after the object; a comma at the very end is the reader's own.
        if body.removesuffix(b",").strip(_BLANKS) or (opener == "}" and closer):
            raise ValueError(f"{file}: more than one object: {text[:80]!r}")
        if opener == "start" and closer != "{":
            raise ValueError(f"{file}: no object")
        return None
    if not body and opener == "{" and closer == "}":
        return None
    try:
        whole = body.decode()
        key, end = json.JSONDecoder().raw_decode(whole)
        colon, _, doc = whole[end:].partition(":")
        if not isinstance(key, str) or colon.strip(" \t\n\r") or not doc.strip(" \t\n\r"):
            raise ValueError
    except ValueError:
        raise ValueError(f"{file}: no key and value: {text[:80]!r}") from None
    return key, doc.strip(" \t\n\r")
