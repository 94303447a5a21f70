"""Quality classifier: supervised subword embeddings averaged per document."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import forgetting, mix, pick, released
from cohortlens.llm.labelled import Sample, held_out, labelled_sample

BUCKETS, DIMENSIONS, EPOCHS = 1 << 16, 16, 6
# Labelled documents fitted on, at most.
FIT_ROWS = 3000
# Lengths of character n-grams (in bytes).
GRAMS = (3, 4)
# Bytes of a text that are looked at together; a longer one is worked off part after part, to its end.
PART = 1 << 20
RATE = 2.0
# Texts of the sample that must hold a feature for it to count.
SEEN = 3
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_FORTH = _powers(_BASE, PART + 1)
_BACK = _powers(pow(_BASE, -1, 1 << 64), PART + 1)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def features(data: bytes) -> np.ndarray:
    """Hashed features of part of a text, repeats included: its words, pairs of words and character n-grams.

    A character n-gram lies within a word or has the white space beside it at one end. A pair of equal
    words is one feature whatever the word, so that stuttering texts share it. Letter case counts.
    """
    raw = np.frombuffer(b" " + data[:PART - 2] + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    values = np.where(space, 32, raw).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _FORTH[: len(values)])])
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, stop = change[0::2], change[1::2]
        words = (total[stop] - total[start]) * _BACK[start]
        out = [_bucket(words, 1)]
        if len(words) > 1:
            pairs = _bucket(words[:-1] * np.uint64(_BASE) + words[1:], 2)
            out.append(np.where(words[1:] == words[:-1], 0, pairs))
        inner = np.concatenate([[0], np.cumsum(space)])
        for n in GRAMS:
            if len(raw) < n:
                continue
            at = np.arange(len(raw) - n + 1)
            at = at[inner[at + n - 1] == inner[at + 1]]
            out.append(_bucket((total[at + n] - total[at]) * _BACK[at], 2 + n))
    return np.concatenate(out)


def parts(text: str) -> Iterator[np.ndarray]:
    data = text.encode("utf-8", "surrogatepass")
    for at in range(0, len(data), PART - 2):
        yield features(data[at : at + PART - 2])


def counts(docs: DataFrame) -> DataFrame:
    """``(label, buckets, n)``: feature buckets of each text and how often each occurs, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, n = [], []
            for text in batch.column("text").to_pylist():
                found, times = np.unique(np.concatenate(list(parts(text))), return_counts=True)
                buckets.append(found.astype("<u2").tobytes())
                n.append(times.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "buckets": pa.array(buckets, pa.binary()), "n": pa.array(n, pa.binary())})

    return docs.select("text", "label").mapInArrow(forgetting(run), "label int, buckets binary, n binary")


def fit(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Learn embeddings and softmax weights by stochastic gradient descent, one document a step.

    A document is the mean of its features' vectors, so what many documents share moves further than the
    words of one. The rate falls in a line to 0; classes weigh by the square root of their imbalance.
    Returned is, per bucket, the difference of the two classes' outputs for its vector, and the
    difference of the biases: for two classes the softmax needs no more. Buckets of fewer than ``SEEN`` texts are 0. With one class only every
    vector is 0 and the bias says which.
    """
    rng = np.random.default_rng(seed)
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    if not n1 or not n0:
        return np.zeros(BUCKETS), float(np.log((n1 + 0.5) / (n0 + 0.5)))
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    w, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    weight = np.sqrt(np.array([(n1 + n0) / (2 * n0), (n1 + n0) / (2 * n1)]))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, times = rows[i]
            share = times / times.sum()
            vectors = e[ids]
            h = share @ vectors
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            p *= weight[labels[i]] * RATE * (1 - done / steps)
            e[ids] = vectors - share[:, None] * (w @ p)
            w -= np.outer(h, p)
            bias -= 0.1 * p
            done += 1
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for ids, _ in rows:
        seen[ids] += 1
    return np.where(seen >= SEEN, e @ (w[:, 1] - w[:, 0]), 0.0), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """Fit on a bounded sample; what reaches the driver is at most ``rows`` lists of bucket counts."""
    sample = Sample(counts(labelled_sample(docs, labels, label, rows, key, text)), ["buckets", "n"])
    model = fit(sample.labels, [(sample.numbers(0, i, "<u2"), sample.numbers(1, i, "<u4")) for i in range(len(sample))])
    # The driver goes on to later steps and holds nothing of the sample there.
    del sample
    released()
    return model


def score(model: tuple[np.ndarray, float], text: Column) -> Column:
    """A number between 0 and 1 from a whole text alone; a null text counts as empty, and an empty one has the bias alone."""
    kept = pickle.dumps((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value, bias = pickle.loads(kept)
        for batch in batches:
            out = np.empty(len(batch))
            for i, t in enumerate(batch):
                total, n = 0.0, 0
                for found in parts(t) if t else ():
                    total += float(value[found].sum(dtype=np.float64))
                    n += len(found)
                z = bias + (total / n if n else 0.0)
                out[i] = 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, z))))
            yield pd.Series(out)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from forgetting(run)(batches)

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` for every row; repeated rows give repeated results, a null id is kept.

    Whole texts are scored, however long; the score of a null or empty text is the bias. Without labels every
    score is 0.5, with labels of one kind only all scores are one number. A score equal to ``threshold`` is predicted 1. An empty table gives an empty result.
    """
    model = train(docs, labels, "quality", rows, key, text)
    out = pick(docs, key=key, text=text).select("key", held_out("key").alias("held_out"), score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("key", key)
