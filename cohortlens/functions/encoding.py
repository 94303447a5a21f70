"""Turning one value into a vector of L slots.

Numbers: the mantissa picks two neighbour slots, the exponent a third. Text: a
running mean of code points picks two neighbour slots per character. Slot
weights are then shifted to minimum 0 and scaled to sum 1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.columns import let, unit_sum

# Vector length, weight of the exponent slot, weight of a new character.
LENGTH = 30
EXPONENT_WEIGHT = 0.5
STRING_DECAY = 0.1

_BLOCK = 64


def zeros(length: int = LENGTH) -> Column:
    return F.array_repeat(F.lit(0.0), length)


def frexp10(x: Column) -> Column:
    """``(mantissa, exponent)`` with ``x = mantissa * 10^exponent``; the exponent is log10 cut towards 0."""
    d = x.cast("double")
    e = F.when(d == 0, F.lit(0)).otherwise(F.log10(F.abs(d)).cast("int"))
    return let(e, lambda n: F.struct((d / F.pow(F.lit(10.0), n)).alias("mantissa"), n.alias("exponent")))


def _slots(pairs: Column, count: int, length: int) -> Column:
    """Spread ``count`` pairs ``(slot, weight)`` over ``length`` slots."""

    def weight(i: int) -> Column:
        shares = [F.when(F.get(pairs, k)["slot"] == i, F.get(pairs, k)["w"]).otherwise(0.0) for k in range(count)]
        return sum(shares[1:], shares[0])

    return F.array(*[weight(i) for i in range(length)])


def _pair(at: Column, weight: Column, length: int) -> Column:
    """A slot index by floored modulo, so that negative positions wrap around."""
    slot = F.floor(F.pmod(at.cast("double"), F.lit(float(length)))).cast("int")
    return F.struct(slot.alias("slot"), weight.cast("double").alias("w"))


def encode_number(x: Column, length: int = LENGTH, exp_weight: float = EXPONENT_WEIGHT, method: str = "ME") -> Column:
    """Vector of a number. ``ME`` is mantissa/exponent coding, ``mod`` marks the slot ``x mod L``; 0 gives zeros."""
    d = x.cast("double")
    if method == "mod":
        dense = let(F.array(_pair(d, F.lit(1.0), length)), lambda p: _slots(p, 1, length))
        return F.when(d == 0, zeros(length)).otherwise(unit_sum(dense))

    def pairs(parts: Column) -> Column:
        m = parts["mantissa"] * F.lit(length / 10.0)
        return let(m, lambda at: let(F.abs(at - at.cast("long")), lambda over: F.array(
            _pair(at, (1 - exp_weight) * (1 - over), length),
            _pair(F.when(at > 0, at + 1).otherwise(at - 1), (1 - exp_weight) * over, length),
            _pair(parts["exponent"], F.lit(exp_weight), length),
        )))

    dense = let(let(frexp10(d), pairs), lambda p: _slots(p, 3, length))
    return F.when(d == 0, zeros(length)).otherwise(unit_sum(dense))


def encode_string(x: Column, length: int = LENGTH, decay: float = STRING_DECAY) -> Column:
    """Vector of a text, character by character inside the JVM; for short values and names."""
    codes = F.transform(F.split(x, ""), lambda ch: F.ascii(ch).cast("double"))

    def step(acc: Column, code: Column) -> Column:
        v = acc["v"] * F.lit(1 - decay) + code * F.lit(decay)
        return let(v, lambda v: let(v * F.lit(float(length)) / F.lit(10.0), lambda sv: let(
            F.struct(
                (sv - F.floor(sv)).alias("over"),
                F.floor(F.pmod(sv, F.lit(float(length)))).cast("int").alias("s0"),
                F.floor(F.pmod(sv + 1, F.lit(float(length)))).cast("int").alias("s1"),
            ),
            lambda s: F.struct(v.alias("v"), F.transform(acc["a"], lambda w, i: w
                + F.when(i == s["s0"], 1.0 - s["over"]).otherwise(0.0)
                + F.when(i == s["s1"], s["over"]).otherwise(0.0)).alias("a")),
        )))

    def folded(all_codes: Column) -> Column:
        start = F.struct(
            F.get(all_codes, 0).alias("v"),
            let(F.array(_pair(F.get(all_codes, 0), F.lit(1.0), length)), lambda p: _slots(p, 1, length)).alias("a"),
        )
        return F.aggregate(F.slice(all_codes, 2, F.greatest(F.size(all_codes) - 1, F.lit(0))), start, step, lambda acc: acc["a"])

    return F.when(F.length(x) > 0, unit_sum(let(codes, folded)))


def text_vector(text: str, length: int = LENGTH, decay: float = STRING_DECAY) -> np.ndarray:
    """The same vector by array arithmetic, linear in the length of the text.

    The running mean is linear, so blocks of characters are filtered side by
    side and the value at each block's start is carried over afterwards.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(float)
    weights = np.zeros(length)
    weights[int(codes[0] % length)] += 1.0
    if len(codes) > 1:
        at = _running_mean(codes, decay)[1:] * length / 10.0
        over = at - np.floor(at)
        weights += np.bincount((at % length).astype(int), 1.0 - over, length)[:length]
        weights += np.bincount(((at + 1) % length).astype(int), over, length)[:length]
    weights -= weights.min()
    total = weights.sum()
    return weights / total if total != 0 else weights


def number_vectors(x: np.ndarray, length: int = LENGTH, exp_weight: float = EXPONENT_WEIGHT, method: str = "ME") -> np.ndarray:
    """Vectors of a whole array of numbers, ``ME`` by mantissa and exponent, ``mod`` by the slot ``x mod L``; NaN and 0 give zeros."""
    if method not in ("ME", "mod"):
        raise ValueError(f"unknown number coding {method!r}")
    out = np.zeros((len(x), length))
    rows = np.flatnonzero(np.isfinite(x) & (x != 0))
    d = x[rows]
    if method == "mod":
        out[rows, (d % length).astype(int) % length] = 1.0
        return unit_rows(out)
    exponent = np.trunc(np.log10(np.abs(d)))
    at = d / 10.0**exponent * (length / 10.0)
    over = np.abs(at - np.trunc(at))
    following = np.where(at > 0, at + 1, at - 1)
    for where, weight in ((at, (1 - exp_weight) * (1 - over)), (following, (1 - exp_weight) * over), (exponent, exp_weight)):
        out[rows, (where % length).astype(int) % length] += weight
    return unit_rows(out)


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v - v.min(axis=1, keepdims=True)
    total = v.sum(axis=1, keepdims=True)
    return np.divide(v, total, out=v, where=total != 0)


def mix_last(base: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """:func:`combine_last` for arrays of vectors."""
    product = np.ones_like(value)
    for n, v in ((1, base), (2, key), (3, value)):
        product = product * (1 + np.abs(v * np.cos(n * v)))
    return unit_rows(product ** (1.0 / 3.0) - 1)


def mix_sum(base: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """:func:`combine_sum` for arrays of vectors."""
    return (base + np.roll(key, -1, axis=1) + np.roll(value, -2, axis=1)) / 3.0


def zscore_rows(v: np.ndarray) -> np.ndarray:
    """Standardise each row; rows without spread become NaN."""
    centred = v - v.mean(axis=1, keepdims=True)
    spread = np.sqrt((centred**2).mean(axis=1, keepdims=True))
    return np.divide(centred, spread, out=np.full_like(centred, np.nan), where=spread > 0)


def text_vectors(texts: pa.Array, length: int = LENGTH, decay: float = STRING_DECAY) -> np.ndarray:
    """Vectors of a whole array of texts, each different text computed once; null and empty give zeros."""
    coded = texts.dictionary_encode()
    table = np.zeros((len(coded.dictionary) + 1, length))
    for i, text in enumerate(coded.dictionary.to_pylist()):
        if text:
            table[i + 1] = text_vector(text, length, decay)
    return table[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1]


@lru_cache(8)
def _response(keep: float) -> np.ndarray:
    """How much of each character of a block is left at each later one."""
    lag = np.arange(_BLOCK)[:, None] - np.arange(_BLOCK)[None, :]
    return np.where(lag >= 0, keep ** np.maximum(lag, 0), 0.0)


def _running_mean(codes: np.ndarray, decay: float) -> np.ndarray:
    keep = 1.0 - decay
    inputs = codes * decay
    inputs[0] = codes[0]
    blocks = -(-len(codes) // _BLOCK)
    grid = np.zeros(blocks * _BLOCK)
    grid[: len(codes)] = inputs
    local = grid.reshape(blocks, _BLOCK) @ _response(keep).T
    carry = 0.0
    starts = np.empty(blocks)
    fade = keep**_BLOCK
    for b, end in enumerate(local[:, -1]):
        starts[b] = carry
        carry = carry * fade + end
    return (local + starts[:, None] * keep ** np.arange(1, _BLOCK + 1)).ravel()[: len(codes)]


def list_array(rows: np.ndarray, valid: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column, null where not valid."""
    n, length = rows.shape
    offsets = pa.array(np.arange(0, n * length + 1, length), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()), mask=pa.array(~valid))


def encode_text(x: Column, length: int = LENGTH, decay: float = STRING_DECAY) -> Column:
    """:func:`encode_string` for long texts: Arrow batches and array arithmetic, whole texts."""

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        some = pc.fill_null(pc.greater(pc.utf8_length(texts), 0), False)
        return list_array(text_vectors(texts, length, decay), some.to_numpy(zero_copy_only=False))

    return encode(x)


def combine_last(base: Column, key: Column, value: Column) -> Column:
    """Vector of one statement from the vectors of its parent, key and value."""

    def factor(x: Column, n: int) -> Column:
        return 1 + F.abs(x * F.cos(n * x))

    parts = F.arrays_zip(base.alias("p"), key.alias("k"), value.alias("v"))
    mixed = F.transform(
        parts,
        lambda t: F.pow(factor(t["p"], 1) * factor(t["k"], 2) * factor(t["v"], 3), F.lit(1.0 / 3.0)) - 1,
    )
    return unit_sum(mixed)


def combine_sum(base: Column, key: Column, value: Column, length: int = LENGTH) -> Column:
    """The additive form: parent at slot j, key at j+1, value at j+2, a third of each."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda j: (F.get(base, j) + F.get(key, F.pmod(j + 1, F.lit(length))) + F.get(value, F.pmod(j + 2, F.lit(length)))) / 3.0,
    )
