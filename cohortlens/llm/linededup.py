"""Removal of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import GOLDEN, forgetting, mix, pick
from cohortlens.session import materialize

# Words of the shortest run that counts as repeated, and of the shortest that is found without fail.
LEAST_WORDS, SURE_WORDS = 20, 40


def lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def line_hashes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line; white space at the ends of a line does not count."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(p.strip().encode("utf-8", "surrogatepass")) for p in parts), np.uint64, len(parts))
    return hashes, np.fromiter((len(p.split()) for p in parts), np.int64, len(parts))


def fingerprints(hashes: np.ndarray, words: np.ndarray, least: int = LEAST_WORDS, sure: int = SURE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs winnowing selects, and of all runs of just ``sure`` words.

    From each line starts the shortest run of at least ``least`` words (a gram) and the shortest of at least
    ``sure`` words (a window). A window selects the gram with the smallest hash among those that lie inside it, the
    last of equal ones. Both are settled by the lines they hold, so two texts that share a run of ``sure`` words
    or more select the same gram in it. Runs that the text's end cuts short are neither grams nor windows.

    A gram may have stood earlier without the lines around it. So the windows themselves are listed as well, and for
    each line the shortest run of at least ``sure`` words that ends with it: these cover every line of a run
    of ``sure`` words or more, and stood wherever it stood.
    """
    n = len(hashes)
    before = np.concatenate([[0], np.cumsum(words)])
    gram_end = np.searchsorted(before, before[:n] + least)  # one past the gram's last line
    window_end = np.searchsorted(before, before[:n] + sure)
    starts = np.flatnonzero((gram_end <= n) & (words > 0))
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        # A polynomial over the lines with words, so that blank lines do not part two copies.
        rank = np.cumsum(words > 0) - (words > 0)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, GOLDEN)]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(words > 0, mix(hashes) * power[rank], np.uint64(0)))])
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(GOLDEN), -1, 1 << 64)))]))

        def hashed(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
            return mix((total[stop] - total[first]) * inverse[rank[first]])

        gram = hashed(starts, gram_end[starts])
        ahead = np.flatnonzero((window_end <= n) & (words > 0))
        stops = np.flatnonzero((before[1:] >= sure) & (words > 0)) + 1
        behind = np.searchsorted(before, before[stops] - sure, side="right") - 1
    ends = gram_end[starts]
    chosen = set()
    for i, start in enumerate(starts.tolist()):
        stop = window_end[start]
        if stop > n:
            break
        inside = int(np.searchsorted(ends, stop, side="right"))
        own = gram[i:inside]
        chosen.add(inside - 1 - int(own[::-1].argmin()))
    picked = np.array(sorted(chosen), dtype=np.int64)
    firsts = np.concatenate([starts[picked], ahead, behind])
    lasts = np.concatenate([ends[picked], window_end[ahead], stops])
    firsts, lasts = np.unique(np.stack([firsts, lasts]), axis=1)
    with np.errstate(over="ignore"):
        return firsts, hashed(firsts, lasts).view(np.int64)


def sketches(docs: DataFrame, least: int, sure: int) -> DataFrame:
    """``(id, th, hashes, words, prints)`` of ``docs(id, th, text)``: packed line hashes, word counts, grams and windows."""
    schema = "id bigint, th bigint, hashes binary, words binary, prints array<struct<at:int,gram:bigint>>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                hashes, words, prints = [], [], []
                for text in part.column("text").to_pylist():
                    h, w = line_hashes(lines(text))
                    at, gram = fingerprints(h, w, least, sure)
                    hashes.append(h.tobytes()), words.append(w.astype("<i4").tobytes())
                    prints.append([{"at": a, "gram": g} for a, g in zip(at.tolist(), gram.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("th"), pa.array(hashes, pa.binary()), pa.array(words, pa.binary()), pa.array(prints, kind)],
                    names=["id", "th", "hashes", "words", "prints"],
                )

    return docs.mapInArrow(forgetting(run), schema)


def _filled(hashes: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that hold words, and their line numbers."""
    at = np.flatnonzero(np.frombuffer(words, dtype="<i4"))
    return np.frombuffer(hashes, dtype=np.uint64)[at], at


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def extended(hashes: pd.Series, words: pd.Series, first_hashes: pd.Series, first_words: pd.Series, pairs: pd.Series) -> pd.Series:
    """Line ranges of a text that repeat another: each joined gram grown both ways while the lines agree."""
    out = []
    for h, w, fh, fw, matches in zip(hashes, words, first_hashes, first_words, pairs):
        own, lines_ = _filled(h, w)
        first, first_lines = _filled(fh, fw)
        ranges, done = [], -1
        for m in sorted(matches, key=lambda m: m["at"]):
            p, q = int(np.searchsorted(lines_, m["at"])), int(np.searchsorted(first_lines, m["first_at"]))
            if p < done and ranges and ranges[-1][2] == p - q:
                continue  # within the run just found
            forward = _common(own[p:], first[q:])
            backward = _common(own[:p][::-1], first[:q][::-1])
            if forward:
                done = p + forward
                ranges.append((int(lines_[p - backward]), int(lines_[done - 1]) + 1, p - q))
        out.append([{"start": a, "stop": b} for a, b, _ in ranges])
    return pd.Series(out)


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS, sure: int = SURE_WORDS) -> DataFrame:
    """``(id, th, ranges)``: line ranges of ``docs(id, th, text)`` to delete; only documents that have any."""
    found = materialize(sketches(docs, least, sure).dropDuplicates(["id", "th"]), "lines")
    prints = found.select("id", "th", F.explode("prints").alias("p")).select("id", "th", "p.at", "p.gram")
    first = prints.groupBy("gram").agg(F.min(F.struct("id", "th", "at")).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = prints.join(first.select("gram", "f"), "gram").where(F.struct("id", "th", "at") > F.col("f"))
    # A document meets each earlier one once, with all the grams they share.
    pairs = later.groupBy("id", "th", F.col("f.id").alias("fid"), F.col("f.th").alias("fth")).agg(
        F.collect_list(F.struct("at", F.col("f.at").alias("first_at"))).alias("pairs")
    )
    own = found.select("id", "th", "hashes", "words")
    other = found.select(F.col("id").alias("fid"), F.col("th").alias("fth"), F.col("hashes").alias("fh"), F.col("words").alias("fw"))
    met = pairs.join(own, ["id", "th"]).join(other, ["fid", "fth"])
    ranges = met.select("id", "th", extended("hashes", "words", "fh", "fw", "pairs").alias("ranges"))
    return ranges.groupBy("id", "th").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("words", T.IntegerType())])


@F.pandas_udf(_CUT)
def without(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    """The text without the line ranges, and how many lines and words went; untouched where there are none."""
    out = []
    for t, cut in zip(text, ranges):
        if cut is None or not len(cut):
            out.append((t, 0, 0))
            continue
        parts = lines(t)
        gone = np.zeros(len(parts), dtype=bool)
        for r in cut:
            gone[r["start"] : r["stop"]] = True
        kept = "\n".join(p for p, g in zip(parts, gone) if not g)
        out.append((kept, int(gone.sum()), sum(len(p.split()) for p, g in zip(parts, gone) if g)))
    return pd.DataFrame(out, columns=["text", "lines", "words"])


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, sure: int = SURE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text``, and ``lines_deleted``, ``words_deleted``.

    Documents are ordered by id. A run of lines that a selected gram shares with the gram's first occurrence,
    as far as the lines around agree as well, is deleted from the later place, be it in another document or
    in the same. No run of fewer than ``least`` words is deleted. A run of ``sure`` words or more
    that stood earlier is always deleted as a whole, also if parts of it had stood still earlier without
    the rest. Every deleted line remains in an earlier place. Lines are equal without the
    white space at their ends; blank lines inside a deleted run go with it and otherwise do not count.

    A null text stays null and an empty one empty. Rows that repeat an id and a text are cut
    alike, as one document; a null id comes last. Ids must be whole numbers. Other columns are kept as they
    are; those named ``lines_deleted`` or ``words_deleted``, in whatever case of letters, are replaced. An empty table gives an
    empty result.
    """
    columns = [c for c in docs.columns if c.lower() not in ("lines_deleted", "words_deleted")]
    identity = F.coalesce(docs[key].cast("long"), F.lit(2**63 - 1)), F.xxhash64(docs[text])
    rows = docs.select(identity[0].alias("id"), identity[1].alias("th"), docs[text].alias("text")).where("text IS NOT NULL AND text <> ''")
    cut = repeated_runs(rows, least, sure).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "ranges")
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), identity[0].alias("__id"), identity[1].alias("__th"))
    joined = whole.join(cut, ["__id", "__th"], "left").select("row", without(F.col("row")[text], F.col("ranges")).alias("cut"))
    kept = [F.col("cut.text").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns]
    return joined.select(*kept, F.col("cut.lines").alias("lines_deleted"), F.col("cut.words").alias("words_deleted"))
