"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import forgetting, pick, released, remembered
from cohortlens.llm.labelled import FIT_ROWS, Sample, held_out, labelled_sample

SLOTS = 1 << 20
TERMS, FACTORS, EPOCHS = 2048, 8, 40
# Least log-likelihood gain of a term (about one false term in two thousand), terms kept whatever their gain,
# and the share of terms hidden from half of the texts in each step.
GAIN, ALWAYS, HIDDEN = 6.0, 64, 0.7
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W_]+")


def chunk_terms(chunk: str) -> list[int]:
    """Hashed terms of a run of characters without white space: each word, and its first four and five letters."""
    out = []
    for word in _WORD.findall(chunk.lower()):
        out.append(f"w{word}")
        out.extend(f"p{word[:n]}" for n in (4, 5) if len(word) > n)
    return [xxhash.xxh3_64_intdigest(t) % SLOTS for t in out]


class Remembered(dict):
    """Values of chunks, worked out on first sight, in a table of bounded size."""

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, chunk: str):
        if len(self) >= self.limit:
            self.clear()
        value = self[chunk] = self.make(chunk)
        return value


def term_slots(docs: DataFrame) -> DataFrame:
    """``(label, slots)``: the distinct term slots of each text as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("terms", lambda: Remembered(chunk_terms))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found: set[int] = set()
                for chunk in set(text.split()):
                    found.update(known[chunk])
                out.append(np.array(sorted(found), dtype="<i4").tobytes())
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "slots": pa.array(out, pa.binary())})

    return docs.select("text", "label").mapInArrow(forgetting(run), "label int, slots binary")


class Machine:
    """``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms present, through the logistic function.

    Only the terms that tell the classes apart best take part; each is present or not, so neither length
    nor repetition dilutes a rare insult. ``w`` weighs terms alone, the factors ``v`` weigh them together.
    """

    def __init__(self, slots: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.slots, self.bias, self.w, self.v = slots, bias, w, v
        self.position = {int(s): i for i, s in enumerate(slots)}

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s).sum(axis=1) - x @ (self.v * self.v).sum(axis=1))

    def score(self, present: list[int]) -> float:
        s = self.v[present].sum(axis=0)
        z = self.bias + self.w[present].sum() + 0.5 * float((s * s).sum() - (self.v[present] ** 2).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -50.0, 50.0))))


def fit(labels: np.ndarray, slots: list[np.ndarray], terms: int = TERMS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 1) -> Machine:
    """Learn a machine from 0/1 labels and each text's distinct slots by stochastic gradient descent (AdaGrad).

    At most ``terms`` slots with the largest log-likelihood gain of at least ``GAIN`` are kept (those of two
    texts or more, ties to the smaller slot). In half of the texts of a step most terms are hidden, so that each
    insult learns to stand alone and not only beside others. The rarer class weighs more, by the square root
    of the imbalance. With one class only, or no text, the machine is its bias.
    """
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float64)
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    prior = (n1 + 0.5) / (n1 + n0 + 1.0)
    if not n1 or not n0:
        return Machine(np.zeros(0, dtype=np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, factors)))
    a, b = np.zeros(SLOTS), np.zeros(SLOTS)
    for label, s in zip(labels, slots):
        (a if label else b)[s] += 1.0
    seen = np.flatnonzero(a + b >= 2)
    p, q = (a[seen] + 0.5) / (n1 + 1), (b[seen] + 0.5) / (n0 + 1)
    m = (a[seen] + b[seen] + 1) / (n1 + n0 + 2)
    gain = sum(n * (r * np.log(r / m) + (1 - r) * np.log((1 - r) / (1 - m))) for n, r in ((n1, p), (n0, q)))
    best = np.lexsort((seen, -gain))
    chosen = np.sort(seen[best[: max(ALWAYS, min(terms, int((gain >= GAIN).sum())))]])
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), dtype=np.uint8)
    for i, s in enumerate(slots):
        at = place[s]
        x[i, at[at >= 0]] = 1
    weight = np.sqrt(np.where(y == 1, (n1 + n0) / (2 * n1), (n1 + n0) / (2 * n0)))
    bias, w, v = 0.0, np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), factors))
    gb, gw, gv = 1e-8, np.full(len(chosen), 1e-8), np.full((len(chosen), factors), 1e-8)
    machine = Machine(chosen, bias, w, v)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            rows = order[at : at + 64]
            shown = rng.random((len(rows), len(chosen))) >= HIDDEN * rng.integers(0, 2, (len(rows), 1))
            xb = x[rows] * shown.astype(np.float64)
            s = xb @ v
            z = bias + xb @ w + 0.5 * ((s * s).sum(axis=1) - xb @ (v * v).sum(axis=1))
            miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]) * weight[rows] / len(rows)
            db, dw = miss.sum(), xb.T @ miss + 1e-4 * w
            dv = xb.T @ (miss[:, None] * s) - v * (xb.T @ miss)[:, None] + 1e-4 * v
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            bias -= 0.2 * db / np.sqrt(gb)
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.02 * dv / np.sqrt(gv)
    machine.bias = float(bias)
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> Machine:
    """Fit on a bounded sample; what reaches the driver is at most ``rows`` lists of term slots."""
    sample = Sample(term_slots(labelled_sample(docs, labels, label, rows, key, text)), ["slots"])
    machine = fit(sample.labels, [sample.numbers(0, i, "<i4") for i in range(len(sample))])
    # The driver goes on to later steps and holds nothing of the sample there.
    del sample
    released()
    return machine


def score(machine: Machine, text: Column) -> Column:
    """A number between 0 and 1 from a whole text alone; a null text counts as empty."""
    kept = pickle.dumps((machine.slots, machine.bias, machine.w, machine.v))
    name = xxhash.xxh3_64_hexdigest(kept)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine(*pickle.loads(kept))
        place = own.position
        known = remembered(("toxicity", name), lambda: Remembered(lambda chunk: tuple(place[s] for s in chunk_terms(chunk) if s in place)))
        for part in parts:
            out = np.empty(len(part))
            for i, t in enumerate(part):
                found: set[int] = set()
                if t:
                    for hit in map(known.__getitem__, set(t.split())):
                        if hit:
                            found.update(hit)
                out[i] = own.score(sorted(found))
            yield pd.Series(out)

    @F.pandas_udf(T.DoubleType())
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from forgetting(run)(parts)

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` for every row; repeated rows give repeated results, a null id is kept.

    Whole texts are scored, however long; the score of a null or empty text is that of no terms, the bias. Without labels every
    score is 0.5, with labels of one kind only all scores are one number. A score equal to ``threshold`` is predicted 1. An empty table gives an empty result.
    """
    machine = train(docs, labels, "toxic", rows, key, text)
    out = pick(docs, key=key, text=text).select("key", held_out("key").alias("held_out"), score(machine, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("key", key)
