"""Near-duplicate texts by b-bit MinHash, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import GOLDEN, Forest, components, forgetting, groups, in_blocks, mix, pick, remembered
from cohortlens.session import materialize

# Minima per document, those of one band, and the low bits that are kept of each.
MINIMA, BANDS, ROWS, BITS = 128, 20, 4, 4
# Standard deviations by which an estimate may fall short before a pair is given up without a look at the sets.
SLACK = 4.0
# Members of a band bucket, or of a candidate group, that meet in one task.
BUCKET_BLOCK, GROUP_BLOCK = 2048, 512
# Word hashes a Python worker remembers.
REMEMBERED = 300_000
_MULTIPLIERS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_NIBBLES = np.uint64(0x1111111111111111)


class WordHashes(dict):
    """64-bit hashes of words (bytes), in a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``n``-word shingles.

    ``A-Z`` are lower-cased; words are parted by space and the control characters 9 to 13. A text of
    fewer than ``n`` words is one shingle, one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            out = mix(out * GOLDEN + h[i : len(h) - size + 1 + i])
        return np.unique(mix(out + np.uint64(size)))


def minima(found: np.ndarray) -> np.ndarray:
    """32-bit minima of the set under ``MINIMA`` hash functions (odd multipliers)."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 512):
            np.minimum(least, (_MULTIPLIERS[:, None] * found[None, at : at + 512]).min(axis=1), out=least)
    return least >> np.uint64(32)


def packed(least: np.ndarray) -> bytes:
    """The ``BITS`` low bits of each minimum, sixteen to a 64-bit number."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).tobytes()


def equal_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many low-bit minima agree, for every row of ``a`` with every row of ``b`` (packed signatures)."""
    differ = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ += np.bitwise_count(x & _NIBBLES)
    return MINIMA - differ


def least_equal(similarity: float) -> float:
    """Agreeing minima from which a pair may reach ``similarity``.

    Unequal minima agree in their low bits by chance with ``c = 2^-BITS``, so a similarity ``s`` shows
    as ``c + (1 - c) s``; the bound lies ``SLACK`` standard deviations below.
    """
    c = 2.0**-BITS
    p = c + (1 - c) * similarity
    return MINIMA * p - SLACK * np.sqrt(MINIMA * p * (1 - p))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """``(id, th, n_shingles, digest, sig, bands)`` of ``docs(id, th, text)``; ``digest`` stands for the whole set.

    Only documents with shingles have a signature and bands.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("words", WordHashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, digests, sigs, bands = [], [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text, n, known)
                    sizes.append(len(found))
                    if not len(found):
                        digests.append(None), sigs.append(None), bands.append(None)
                        continue
                    least = minima(found)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sigs.append(packed(least))
                    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
                    key = rows[:, 0]
                    with np.errstate(over="ignore"):
                        for r in range(1, ROWS):
                            key = mix(key * GOLDEN + rows[:, r])
                        key = mix(key + np.arange(BANDS, dtype=np.uint64))
                    bands.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("th"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "th", "n_shingles", "digest", "sig", "bands"],
                )

    return docs.mapInArrow(forgetting(run), f"id {kind}, th bigint, n_shingles bigint, digest binary, sig binary, bands array<bigint>")


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block of a group; the same rows where a block meets itself."""
    first, own = table["first"][0].as_py(), table["own"].to_numpy()
    if first == table["second"][0].as_py():
        everything = np.arange(table.num_rows)
        return everything, everything
    return np.flatnonzero(own == first), np.flatnonzero(own != first)


def _edges(ids: list, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = pa.array([ids[i] for i, _ in pairs], pa.int64())
    b = pa.array([ids[j] for _, j in pairs], pa.int64())
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def candidate_links(classes: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links enough to connect all documents of a band bucket whose estimate may reach ``similarity``.

    Pairs are compared in blocks, by bit counts, and only a spanning forest of the promising ones leaves a task.
    """
    bound = least_equal(similarity)
    buckets = classes.select("id", "sig", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    placed = in_blocks(buckets.join(full, "key"), F.col("size"), BUCKET_BLOCK, F.col("id"))
    keys = ["key", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            left, right = _sides(table)
            sig, ids = _signatures(table), table["id"].to_pylist()
            forest, pairs = Forest(len(ids)), []
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                good = equal_minima(sig[rows], sig[right]) >= bound
                for i, row in enumerate(rows.tolist()):
                    near = right[good[i]]
                    near = near[forest.root[near] != forest.root[row]]
                    while len(near):
                        forest.join(row, int(near[0]))
                        pairs.append((row, int(near[0])))
                        near = near[forest.root[near] != forest.root[row]]
            if pairs:
                yield _edges(ids, pairs)

    dealt = placed.select("key", "first", "second", "own", "id", "sig").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(forgetting(run), "a bigint, b bigint").where("a <> b").distinct()


def confirmed_links(docs: DataFrame, candidates: DataFrame, classes: DataFrame, n: int, similarity: float) -> DataFrame:
    """``(a, b)``: links enough to connect all classes that whole sets link, within groups of candidates.

    ``classes`` are ``(id, doc, th, sig)``, ``doc`` and ``th`` being id and hash of a text of the class in ``docs(id, th, text)``.

    The members of a candidate group come together, in blocks that meet pair by pair, and the most promising
    pairs are looked at first; a pair whose documents are connected already tells nothing new.
    """
    share = round(similarity * 100)
    bound = least_equal(similarity)
    group = materialize(components(candidates, "candidates"), "groups")
    size = group.groupBy("component").agg(F.count("*").alias("size"))
    members = group.join(size, "component").join(classes, "id")
    texts = members.join(docs.select(F.col("id").alias("doc"), "th", "text"), ["doc", "th"])
    keys = ["component", "first", "second"]
    placed = in_blocks(texts, F.col("size"), GROUP_BLOCK, F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("words", WordHashes)
        for table in groups(batches, keys):
            # A row that is repeated brings the text of its class more than once.
            table = table.take(pa.array(np.unique(table["id"].to_numpy(), return_index=True)[1]))
            left, right = _sides(table)
            sig, ids = _signatures(table), table["id"].to_pylist()
            sets = [shingles(t, n, known) for t in table["text"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            same = equal_minima(sig[left], sig[right])
            fits = np.minimum(sizes[left][:, None], sizes[right][None, :]) * 100 >= share * np.maximum(sizes[left][:, None], sizes[right][None, :])
            good = (same >= bound) & fits
            if left is right:
                good &= np.tri(len(left), k=-1, dtype=bool)
            i, j = np.nonzero(good)
            order = np.argsort(-same[i, j], kind="stable")
            forest, pairs = Forest(len(ids)), []
            for a, b in zip(left[i[order]].tolist(), right[j[order]].tolist()):
                if forest.root[a] == forest.root[b]:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                    forest.join(a, b)
                    pairs.append((a, b))
            if pairs:
                yield _edges(ids, pairs)

    dealt = placed.select("component", "first", "second", "own", "id", "sig", "text").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(forgetting(run), "a bigint, b bigint").where("a <> b")


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Two texts are linked when their sets of ``n``-word shingles share at least ``similarity`` of their union;
    ``component_id`` is the smallest id reachable by links and ``kept`` marks the row that bears it.

    Texts with equal sets are one class from the start, so copies cost one row each. Classes that agree in a
    band of minima are compared by packed low bits; groups of promising ones, in which every
    link lies, are then confirmed on whole sets. A pair at the bound meets in a band with probability
    0.99997 (``BANDS`` bands of ``ROWS``) and passes the estimate as surely; nothing else is left out.
    Sets hold 64-bit hashes of shingles.

    A null or empty text has no shingles and links with nothing. A null id has a null component and is kept.
    Rows of one id, whether their texts are equal or not, have one component, linked by all their texts; ids must be whole numbers.
    """
    rows = pick(docs, id=key, text=text).withColumns({"id": F.col("id").cast("long"), "th": F.xxhash64("text")}).select("id", "th", "text")
    found = materialize(sketches(rows, n), "sketches")
    known = found.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min(F.struct("id", "th", "sig", "bands")).alias("one")).select("digest", "one.*")
    # Classes have numbers of their own: an id that is repeated with another text stands for several.
    classes = materialize(classes.withColumnRenamed("id", "doc").withColumn("id", F.monotonically_increasing_id()), "classes")
    candidates = candidate_links(classes, similarity)
    linked = confirmed_links(rows, candidates, classes.select("id", "doc", "th", "sig"), n, similarity)
    ends = [classes.select(F.col("id").alias(c), F.col("doc").alias(f"doc_{c}")) for c in ("a", "b")]
    links = linked.join(ends[0], "a").join(ends[1], "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    copies = known.join(classes.select("digest", F.col("doc").alias("rep")), "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    whole = components(links.union(copies), "duplicates")
    out = found.select("id", "n_shingles").join(whole, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
