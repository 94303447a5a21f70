"""Files of token ids, packed into 64-bit words whose top four bits say how many ids the word holds.

Layout of a file, all numbers little-endian and unsigned with 64 bits unless said otherwise:

``MAGIC`` | packed words of all blocks | escaped values of all blocks | per block: first id, first word, first escape |
per document: first id, key (signed), whether it has a key (one byte each) | words, escapes, blocks, documents, ids | ``MAGIC``

A block is up to ``BLOCK`` ids of one document. Its words hold just its ids, so any run of blocks is
decoded by itself, and all its words at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import one_each, pick
from cohortlens.llm.tokens import portions, tokenizer_path, word_ids
from cohortlens.session import materialize, scratch_path

# Fixed values of the format: ids per word by selector 1 to 14 (each gets 60 // ids bits); selector 0 is an escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
PAYLOAD, MAGIC = 60, b"SIMPLE8B"
# Ids of a block; bytes of text of a file, more or less; bytes of text packed and ids decoded at once.
BLOCK, FILE_BYTES, PACKED, DECODED = 4096, 32 << 20, 2 << 20, 1 << 20


# --- words ---------------------------------------------------------------------------------


def pack(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and escapes of blocks of unsigned ids, and how many of each a block has; block ``i`` ends before ``ends[i]``.

    A word takes as many of the next ids as fit. The longest such run is worked out for all positions
    at once from running maxima of the bits an id needs; only the walk from word to word is a loop. An id of more than
    60 bits goes to the escapes of its block, and a word of selector 0 with its number there stands for it.
    """
    ids = ids.astype(np.uint64, copy=False)
    n = len(ids)
    left = (np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)).astype(np.int32)  # ids from here to the end of the block
    take = np.zeros(n, dtype=np.uint8)  # 0: an escape
    most, reach = _bit_lengths(ids), 1  # most bits of the next `reach` ids
    for count in reversed(COUNTS):
        if count > reach:  # at most twice as many
            further = most[count - reach :].copy()
            most[: len(further)] = np.maximum(most[: len(further)], further)
            reach = count
        take[(left >= count) & (most <= PAYLOAD // count)] = count
    step = np.maximum(take, 1).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, dtype=np.int64)
    counts = take[starts]
    words = np.zeros(len(starts), dtype=np.uint64)
    for selector, count in enumerate(COUNTS, 1):
        own = np.flatnonzero(counts == count)
        word = np.full(len(own), selector << PAYLOAD, dtype=np.uint64)
        for k in range(count):
            word |= ids[starts[own] + k] << np.uint64(k * (PAYLOAD // count))
        words[own] = word
    block = np.searchsorted(ends, starts, side="right")
    escaped = np.flatnonzero(counts == 0)
    per_block = np.bincount(block[escaped], minlength=len(ends)).astype(np.int64)
    words[escaped] = np.arange(len(escaped)) - (np.cumsum(per_block) - per_block)[block[escaped]]
    return words, ids[starts[escaped]], np.bincount(block, minlength=len(ends)).astype(np.int64), per_block


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits an id needs, at least 1, each half by the exponent of its value as a real number, which is exact."""
    low, high = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1], np.frexp((ids >> np.uint64(32)).astype(np.float64))[1]
    return np.maximum(np.where(high > 0, high + 32, low), 1).astype(np.uint8)


def unpack(words: np.ndarray, escapes: np.ndarray, first_escape: np.ndarray | int = 0) -> np.ndarray:
    """All ids of a run of words at once; ``first_escape`` is where the escapes of a word's block begin."""
    selector = (words >> np.uint64(PAYLOAD)).astype(np.int64)
    if len(selector) and selector.max() > len(COUNTS):
        raise ValueError("a word with an unknown selector")
    counts = np.array([1, *COUNTS], dtype=np.int64)[selector]
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint64)
    starts = ends - counts
    for s, count in enumerate(COUNTS, 1):
        own = np.flatnonzero(selector == s)
        width = PAYLOAD // count
        below = np.uint64((1 << width) - 1)
        for k in range(count):
            out[starts[own] + k] = (words[own] >> np.uint64(k * width)) & below
    own = np.flatnonzero(selector == 0)
    if len(own):
        out[starts[own]] = escapes[words[own].astype(np.int64) + (first_escape if np.isscalar(first_escape) else first_escape[own])]
    return out


# --- files ---------------------------------------------------------------------------------


class IdFile:
    """Writes documents one after the other; only indexes and escapes wait in memory, 24 bytes a block and 17 a document."""

    def __init__(self, folder: str):
        self.where, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{uuid.uuid4().hex}.s8b"
        self.out = self.where.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.words = self.escaped = self.ids = 0
        self.blocks: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.docs: list[tuple[int, int, bool]] = []

    def add(self, key: int | None, n: int, words: bytes, escapes: bytes, per_block: bytes) -> None:
        """One document of ``n`` ids: its words, its escapes, and of each block how many words and escapes (32-bit pairs)."""
        sizes = np.frombuffer(per_block, "<u4").reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(sizes, axis=0)
        begins = ends - sizes
        first = self.ids + BLOCK * np.arange(len(sizes))
        self.blocks.append(np.column_stack([first, self.words + begins[:, 0], self.escaped + begins[:, 1]]).astype("<u8"))
        self.docs.append((self.ids, key or 0, key is not None))
        self.out.write(words)
        if escapes:
            self.escapes.append(np.frombuffer(escapes, "<u8"))
        self.ids += n
        self.words += len(words) // 8
        self.escaped += len(escapes) // 8

    def close(self) -> tuple[str, int, int, int]:
        """Write the indexes; path, documents, ids and bytes of the file."""
        for e in self.escapes:
            self.out.write(e.tobytes())
        blocks = np.concatenate([*self.blocks, np.zeros((0, 3), "<u8")])
        first, key, has = zip(*self.docs) if self.docs else ((), (), ())
        for part in (blocks.tobytes(), np.array(first, "<u8").tobytes(), np.array(key, "<i8").tobytes(), np.array(has, "u1").tobytes()):
            self.out.write(part)
        self.out.write(np.array([self.words, self.escaped, len(blocks), len(self.docs), self.ids], "<u8").tobytes() + MAGIC)
        size = self.out.tell()
        self.out.close()
        return self.path, len(self.docs), self.ids, size


class IdFileReader:
    """Random access to the documents of a file: its indexes in memory, words read and decoded by runs of blocks."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.file = where.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48) if size >= 56 else b""
        if tail[40:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no complete file of packed ids")
        self.n_words, self.n_escapes, blocks, self.n_docs, self.n_ids = np.frombuffer(tail[:40], "<u8").astype(np.int64).tolist()
        at = 8 + 8 * self.n_words
        if at + 8 * self.n_escapes + 24 * blocks + 17 * self.n_docs + 48 != size:
            raise ValueError(f"{path} differs from the sizes at its end")
        self.escapes = np.frombuffer(self.file.read_at(8 * self.n_escapes, at), "<u8")
        at += 8 * self.n_escapes
        self.blocks = np.frombuffer(self.file.read_at(24 * blocks, at), "<u8").reshape(-1, 3).astype(np.int64)
        at += 24 * blocks
        self.first = np.frombuffer(self.file.read_at(8 * self.n_docs, at), "<u8").astype(np.int64)
        at += 8 * self.n_docs
        keys = np.frombuffer(self.file.read_at(8 * self.n_docs, at), "<i8")
        has = np.frombuffer(self.file.read_at(self.n_docs, at + 8 * self.n_docs), "u1")
        self.keys = pa.array(keys.astype(np.int64), mask=has == 0)

    def decode(self, low: int, high: int) -> np.ndarray:
        """Ids of blocks ``low`` to ``high - 1``."""
        bounds = np.append(self.blocks[low:high, 1], self.blocks[high, 1] if high < len(self.blocks) else self.n_words)
        words = np.frombuffer(self.file.read_at(8 * int(bounds[-1] - bounds[0]), 8 + 8 * int(bounds[0])), "<u8")
        first_escape = np.repeat(self.blocks[low:high, 2], np.diff(bounds)) if self.n_escapes else 0
        return unpack(words, self.escapes, first_escape)

    def portions(self, most: int = DECODED) -> Iterator[tuple[int, int]]:
        """Runs of blocks of about ``most`` ids, which together are the whole file."""
        at, n = 0, len(self.blocks)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(self.blocks[:, 0], self.blocks[at, 0] + most)))
            yield at, stop
            at = stop


# --- jobs ----------------------------------------------------------------------------------


class Places:
    """The order of files: which of them a row belongs to, by its key and, among rows of one key, by its checksum.

    ``bounds`` are keys in ascending order that part the rows into files of about equally many; a key that is a bound
    several times has the rows of as many files. ``empty`` files before them hold rows without a key.
    """

    def __init__(self, bounds: list[int], empty: int):
        self.bounds, self.empty = np.array(bounds, dtype=np.int64), empty
        self.count = empty + len(bounds) + 1

    def of(self, keys: pa.Array, crc: np.ndarray) -> np.ndarray:
        none = keys.is_null().to_numpy(zero_copy_only=False)
        key = keys.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(self.bounds, key, "left"), np.searchsorted(self.bounds, key, "right")
        first, files = np.where(none, 0, self.empty + low), np.where(none, max(self.empty, 1), np.maximum(high - low, 1))
        return first + (crc * files >> 32)


def places(docs: DataFrame, key: str, text: str, file_bytes: int) -> Places:
    """Files for all rows, from the bytes of their texts and the quantiles of their keys: one number a file reaches the driver."""
    rows = pick(docs, key=key, text=text).select(F.col("key").cast("long").alias("key"), "text")
    n, keyed, size = rows.agg(F.count("*"), F.count("key"), F.sum(F.octet_length("text"))).first()
    files = max(1, -(-(size or 0) // file_bytes))
    wanted = max(1, round(files * keyed / n)) if n else 1
    marks = [i / wanted for i in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx("key", marks, 20 * wanted)).first()[0] if marks else []
    return Places(bounds or [], -(-files * (n - keyed) // n) if n else 0)


def encoded(docs: DataFrame, order: Places, key: str = "doc_id", text: str = "text", end: int = 2, path: str | None = None) -> DataFrame:
    """``(place, key, n, crc32, words, escapes, per_block)``: packed ids of each whole text and the ``end`` id after them."""
    rows = pick(docs, key=key, text=text).withColumn("key", F.col("key").cast("long"))
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(path)
        for batch in batches:
            for at, stop in portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), PACKED):
                part = batch.slice(at, stop - at)
                ids, ends = table.encode(part.column(1))
                yield _packed(part.column(0), np.insert(ids, ends[1:], end), ends + np.arange(len(ends)), order)

    return rows.mapInArrow(run, "place int, key bigint, n bigint, crc32 bigint, words binary, escapes binary, per_block binary")


def _packed(keys: pa.Array, ids: np.ndarray, ends: np.ndarray, order: Places) -> pa.RecordBatch:
    """Documents ``ids[ends[i]:ends[i + 1]]``, none of them empty, each cut into blocks."""
    sizes = np.diff(ends)
    blocks = -(-sizes // BLOCK)
    last = np.cumsum(blocks)
    inner = np.arange(last[-1]) - np.repeat(last - blocks, blocks) + 1
    stops = np.minimum(np.repeat(ends[:-1], blocks) + BLOCK * inner, np.repeat(ends[1:], blocks))
    words, escapes, n_words, n_escapes = pack(ids, stops)
    pairs = np.column_stack([n_words, n_escapes]).astype("<u4")
    data = memoryview(ids.astype("<u4")).cast("B")
    crc = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], dtype=np.int64)
    upto = lambda per: np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], last])]  # noqa: E731  sums at the end of each document
    parts = [(words.astype("<u8"), 8, upto(n_words)), (escapes.astype("<u8"), 8, upto(n_escapes)), (pairs.ravel(), 4, 2 * np.concatenate([[0], last]))]
    held = [pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer((w * e).astype("<i8")), pa.py_buffer(x)]).cast(pa.binary()) for x, w, e in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array(order.of(keys, crc).astype(np.int32)), keys, pa.array(sizes, pa.int64()), pa.array(crc), *held],
        names=["place", "key", "n", "crc32", "words", "escapes", "per_block"],
    )


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end: int = 2, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all documents in ascending order of keys; the stored list ``place, path, docs, ids, bytes`` of the files.

    Keys are whole numbers; a row without one comes first. Rows with the same key stand in the order of the checksum and
    number of their ids. A null or empty text is the ``end`` id alone. Texts are tokenized and packed where they are read; what
    is then dealt to files by ranges of keys is some two bytes an id. Files hold about ``file_bytes`` of text each, ``place`` being their
    order; the different texts of a key that has many rows are dealt to several files, equal rows of one key to one.
    A task that is run again writes other files; only those in the list count. An empty table gives an empty list.
    """
    order = places(docs, key, text, file_bytes)
    rows = encoded(docs, order, key, text, end, path)
    dealt = rows.repartitionById(order.count, F.col("place")).sortWithinPartitions("place", "key", "crc32", "n")
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    names = ["place", "key", "n", "words", "escapes", "per_block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = None, None

        def told() -> pa.RecordBatch:
            file, documents, ids, size = out.close()
            return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "path": [file], "docs": [documents], "ids": [ids], "bytes": [size]})

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for own, *document in zip(*[batch.column(i).slice(at, 512).to_pylist() for i in range(len(names))]):
                    if own != place:
                        if out is not None:
                            yield told()
                        out, place = IdFile(folder), own
                    out.add(*document)
        if out is not None:
            yield told()

    return materialize(dealt.select(*names).mapInArrow(run, "place int, path string, docs bigint, ids bigint, bytes bigint"), "id-files")


def read(files: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Read listed files back: ``key, start, n_tokens, ids_crc32[, ids]``, ``start`` counting the ids of all documents before.

    Each file is a task of its own and decoded by runs of blocks, so a task holds about ``DECODED`` ids, or one document with
    ``ids`` (unsigned 32-bit numbers). The order of the files, a short row each, is the only thing summed in one task.
    """
    before = F.sum("ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    listed = materialize(files.select("path", F.coalesce(before, F.lit(0)).alias("base")), "id-file-bases")
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _documents(IdFileReader(where, path), base, ids)

    return one_each(listed, "path").mapInArrow(run, schema)


def _documents(file: IdFileReader, base: int, ids: bool) -> Iterator[pa.RecordBatch]:
    bounds = np.append(file.first, file.n_ids)
    crc, held = 0, []
    for low, high in file.portions():
        data = memoryview(file.decode(low, high).astype("<u4")).cast("B")
        begin, stop = int(file.blocks[low, 0]), int(file.blocks[low, 0]) + len(data) // 4
        docs = range(int(np.searchsorted(bounds, begin, side="right")) - 1, int(np.searchsorted(bounds[:-1], stop)))
        done: list[tuple] = []
        for d in docs:
            a, b = int(bounds[d]), int(bounds[d + 1])
            piece = data[4 * (max(a, begin) - begin) : 4 * (min(b, stop) - begin)]
            crc = zlib.crc32(piece, crc)
            if ids:
                held.append(bytes(piece))
            if b <= stop:  # the last piece of the document
                done.append((file.keys[d].as_py(), base + a, b - a, crc, *([b"".join(held)] if ids else [])))
                crc, held = 0, []
        if done:
            columns = zip(*done)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(done[0])])


def id_folder(spark) -> str:
    """A fresh folder for files of ids below the shared one."""
    return scratch_path(spark, "ids")
