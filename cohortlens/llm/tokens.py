"""Token ids of whole texts with a public word-level BPE tokenizer, one Arrow batch at a time."""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cohortlens.llm.common import forgetting, pick, remembered

# Words whose ids a Python worker remembers, beyond which it starts anew; bytes of text taken at once; marks that end words.
REMEMBERED_WORDS, PORTION, MARKS = 400_000, 2 << 20, ".,!?"
# The tokenizer's own splitting rule: a fixed value.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

# How byte-level tokenizers spell bytes: printable ones stand for themselves, the others in turn for the letters from U+0100 on.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SPELLING = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(0x100) if b not in _SELF)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of whole texts from a table of words, learned on first sight.

    The tokenizer splits a text into words before it merges letters, and white space always parts words, so
    a text's ids are those of its words in turn. A portion of texts is lower-cased, split at white space and reduced to
    its different runs by Arrow, most of which are a word or a word and one mark. Only words not seen before
    reach the tokenizer's merges. Texts outside Latin-1, with separator control characters or with a special token
    are left to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = REMEMBERED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # The tokenizer's own last step for words that are in lower case and spelled in its letters.
        self.merge = self.tokenizer.model.tokenize
        self.forget()

    def forget(self) -> None:
        """Empty the table: word -> place, and for each place where its ids begin and how many there are."""
        self.place: dict[str, int] = {}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def places(self, words: list[str]) -> np.ndarray:
        """Places of words in the table; new ones are merged and entered."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            spelled = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(SPELLING) for w in new]
            each = [[t.id for t in self.merge(w)] for w in spelled]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(each), "<u4", sizes.sum())])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different runs one after the other, and where each run's begin and how many there are."""
        trimmed = pc.utf8_rtrim(runs, MARKS)
        tail = pc.subtract(pc.binary_length(runs), pc.binary_length(trimmed)).to_numpy(zero_copy_only=False)
        simple = pc.utf8_is_alpha(trimmed).to_numpy(zero_copy_only=False) & (tail <= 1)
        marked = np.flatnonzero(simple & (tail == 1))
        rest = np.flatnonzero(~simple)
        split = [WORDS.findall(r) for r in runs.take(pa.array(rest)).to_pylist()]
        counts = 1 + tail.astype(np.int64)
        counts[rest] = [len(x) for x in split]
        starts = np.cumsum(counts) - counts
        parts = np.zeros(counts.sum(), dtype=np.int64)
        words = trimmed.filter(pa.array(simple)).dictionary_encode()
        parts[starts[simple]] = self.places(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        marks = pc.utf8_slice_codeunits(runs.take(pa.array(marked)), -1).dictionary_encode()
        parts[starts[marked] + 1] = self.places(marks.dictionary.to_pylist())[marks.indices.to_numpy(zero_copy_only=False)]
        inner = np.arange(counts[rest].sum()) - np.repeat(np.cumsum(counts[rest]) - counts[rest], counts[rest])
        parts[np.repeat(starts[rest], counts[rest]) + inner] = self.places(list(itertools.chain.from_iterable(split)))
        ids, sizes = gathered(self.ids, self.first[parts], self.size[parts])
        size = np.bincount(np.repeat(np.arange(len(runs)), counts), sizes, len(runs)).astype(np.int64)
        return ids, np.cumsum(size) - size, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a portion of texts (null: empty), one after the other, and where each text's begin and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = _left_whole(texts)
        if len(odd):
            apart = np.zeros(len(texts), dtype=bool)
            apart[odd] = True
            whole = {int(i): np.frombuffer(self.whole(texts[int(i)].as_py()), "<u4") for i in odd}
            texts = pc.if_else(pa.array(apart), "", texts)
        if len(self.place) > self.most:
            self.forget()
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = split.flatten().dictionary_encode()
        ids, first, size = self.runs(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids, sizes = gathered(ids, first[at], size[at])
        bounds = split.offsets.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds - bounds[0]]
        if len(odd):
            parts = [whole[i] if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, ends


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``data`` one after the other, and their sizes."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _left_whole(texts: pa.Array) -> np.ndarray:
    """Numbers of the texts that are outside Latin-1, hold a separator control character or perhaps a special token."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    hits = [np.flatnonzero((data > 0xC3) | ((data >= 0x1C) & (data <= 0x1F)))]
    mark = np.flatnonzero(data == ord("|"))
    hits.append(mark[(mark > 0) & (data[mark - 1] == ord("<"))])
    return np.unique(np.searchsorted(bounds - bounds[0], np.concatenate(hits), side="right") - 1)


def portions(sizes: np.ndarray, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a larger row is a range of its own."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop
        at = stop


def word_ids(path: str) -> WordIds:
    """The worker's table."""
    return remembered(("ids", path), lambda: WordIds(path))


def token_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 4096, end: int = 1, path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, ids)``: token ids of each text, then ``end``, cut after every ``length`` ids.

    Only a document of more than ``length`` ids has several pieces, all full but the last. ``ids`` are
    little-endian unsigned 32-bit numbers in a binary value (left out with ``with_ids=False``), ``ids_crc32`` their
    unsigned checksum, ``start`` the number of the document's ids before the piece. A null or empty text is
    the ``end`` id alone, so every row gives at least one piece; repeated rows give repeated pieces.
    """
    rows = pick(docs, key=key, text=text)
    path = path or tokenizer_path()
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    final = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for at, stop in portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(at, stop - at)
                ids, ends = words.encode(part.column(1))
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                owner, pieces = [], []
                for i, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    for n, first in enumerate(range(0, high - low + 1, length)):
                        last = min(first + length, high - low)
                        chunk = data[4 * (low + first) : 4 * (low + last)]
                        chunk = bytes(chunk) + final if last - first < length else chunk
                        owner.append(i)
                        pieces.append((n, first, len(chunk) // 4, zlib.crc32(chunk), bytes(chunk) if with_ids else None))
                number, start, size, crc, held = zip(*pieces)
                columns = [part.column(0).take(pa.array(owner, pa.int32())), pa.array(number, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, size, crc)]
                if with_ids:
                    columns.append(pa.array(held, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return rows.mapInArrow(forgetting(run), schema).withColumnRenamed("key", key)
