"""Fingerprints: one fixed-length vector per row or per nested document.

Every row becomes an array of *statements* (key and value of each kept cell),
and the vector is computed from that array inside the row: nothing is shuffled.
Cells are chosen by column expressions; the vectors are then computed for whole
Arrow batches at once. Higher-order functions over the slots give the same
numbers (see ``functions.encoding``) but were about eight times slower when measured.

``combine="last"`` reproduces the reference result, in which each statement
replaces the vector of the one before, so that only the last kept column
counts. ``combine="sum"`` adds the statements up and uses every column.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import is_real
from cohortlens.functions.encoding import (
    EXPONENT_WEIGHT,
    LENGTH,
    STRING_DECAY,
    list_array,
    mix_last,
    mix_sum,
    number_vectors,
    text_vector,
    text_vectors,
    zscore_rows,
)

_INTEGERS = {"tinyint", "smallint", "int", "bigint"}
_REALS = {"float", "double"}


def kept(x: Column, dtype: str) -> Column:
    """Whether a cell becomes a statement: any integer or boolean, and any other value that is not empty or 0."""
    if dtype in _REALS:
        return is_real(x, dtype) & (x != 0)
    if dtype.startswith("decimal"):
        return x.isNotNull() & (x != 0)
    if dtype == "string":
        return x.isNotNull() & (x != "")
    if dtype.startswith(("array", "map")):
        return x.isNotNull() & (F.size(x) > 0)
    return x.isNotNull()


def _cell(df: DataFrame, pos: int, name: str, dtype: str) -> Column:
    x = F.col(f"`{name}`")
    numeric = dtype in _INTEGERS or dtype in _REALS or dtype == "boolean"
    return F.when(kept(x, dtype), F.struct(
        F.lit(pos).alias("pos"),
        (x.cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
        (x if dtype == "string" else F.lit(None).cast("string")).alias("txt"),
    ))


def _names(df: DataFrame, key: str) -> list[str]:
    """The columns that may have cells."""
    names = [c for c in df.columns if c != key]
    if not names:
        raise ValueError("no column left to fingerprint")
    if "" in names:
        raise ValueError("an empty column name has no vector")
    types = dict(df.dtypes)
    for name in names:
        if types[name].startswith(("struct", "map")):
            raise ValueError(f"column {name} is nested; use fingerprint_nested")
    return names


def _cells(df: DataFrame, key: str) -> tuple[list[str], Column]:
    names, types = _names(df, key), dict(df.dtypes)
    cells = F.array(*[_cell(df, i, n, types[n]) for i, n in enumerate(names)])
    return names, F.filter(cells, lambda c: c.isNotNull())


def _last_cell(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """How many cells are kept, and the last of them, without a list of all."""
    types = dict(df.dtypes)
    size = sum((kept(F.col(f"`{n}`"), types[n]).cast("int") for n in names[1:]), kept(F.col(f"`{names[0]}`"), types[names[0]]).cast("int"))
    return size, F.coalesce(*[_cell(df, i, n, types[n]) for i, n in reversed(list(enumerate(names)))])


def statements(df: DataFrame, key: str) -> DataFrame:
    """One row per kept cell: ``(key, pos, parent, name, num, txt)``."""
    names, cells = _cells(df, key)
    labels = F.array(*[F.lit(n) for n in names])
    rows = df.select(F.col(key), F.explode_outer(cells).alias("c")).where("c IS NOT NULL")
    return rows.select(
        key, F.col("c.pos").alias("pos"), F.lit("root").alias("parent"),
        F.get(labels, F.col("c.pos")).alias("name"), F.col("c.num").alias("num"), F.col("c.txt").alias("txt"),
    )


def statement_counts(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.size(_cells(df, key)[1]).alias("statements"))


def fingerprint(
    df: DataFrame,
    key: str,
    length: int = LENGTH,
    combine: str = "last",
    decimals: int | None = 3,
    exp_weight: float = EXPONENT_WEIGHT,
    decay: float = STRING_DECAY,
    numeric: str = "ME",
) -> DataFrame:
    """``(key, statements, fp)`` for a flat frame; ``fp`` is null for a row without kept cells.

    ``numeric`` is the coding of numbers: ``ME`` (mantissa and exponent) or ``mod``.

    Column names are known before the job starts, so their vectors are part of
    the plan (``length`` numbers per column) and only values cost per row.
    """
    names = _names(df, key)
    key_vectors = np.array([text_vector(n, length, decay) for n in names])
    options = (key_vectors, exp_weight, decay, decimals, numeric)
    if combine == "last":
        size, last = _last_cell(df, names)
        rows = df.select(key, size.alias("statements"), last.alias("cell")).select(key, "statements", "cell.pos", "cell.num", "cell.txt")
        vectors = _last_cells(*options)("pos", "num", "txt")
    elif combine == "sum":
        rows = df.select(key, _cells(df, key)[1].alias("cells"))
        rows = rows.select(key, F.size("cells").alias("statements"), *[F.transform("cells", lambda c: c[f]).alias(f) for f in ("pos", "num", "txt")])
        vectors = _summed_cells(*options)("pos", "num", "txt")
    else:
        raise ValueError(f"unknown combine {combine!r}")
    return rows.select(key, "statements", vectors.alias("fp"))


# Cells whose vectors a task holds at once; a row with more of them is taken alone.
CELLS_AT_ONCE = 32_768


def _values(num: pa.Array, txt: pa.Array, length: int, exp_weight: float, decay: float, numeric: str) -> np.ndarray:
    """Vectors of cells, each a number, a text or neither; one of the two summands is always zeros."""
    return number_vectors(num.to_numpy(zero_copy_only=False).astype(float), length, exp_weight, numeric) + text_vectors(txt, length, decay)


def _portions(sizes: np.ndarray) -> list[tuple[slice, slice]]:
    """Rows and their cells in portions of bounded size."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, at = [], 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS_AT_ONCE, side="right")) - 1)
        out.append((slice(at, stop), slice(int(ends[at]), int(ends[stop]))))
        at = stop
    return out


def _finished(rows: np.ndarray, decimals: int | None) -> pa.Array:
    """Standardised and rounded; null for a vector without spread."""
    rows = zscore_rows(rows)
    valid = ~np.isnan(rows[:, 0])
    return list_array(rows if decimals is None else np.round(rows, decimals), valid)


def _last_cells(key_vectors: np.ndarray, exp_weight: float, decay: float, decimals: int | None, numeric: str):
    length = key_vectors.shape[1]

    @F.arrow_udf("array<double>")
    def vectors(pos: pa.Array, num: pa.Array, txt: pa.Array) -> pa.Array:
        value = _values(num, txt, length, exp_weight, decay, numeric)
        some = pos.is_valid().to_numpy(zero_copy_only=False)
        key = key_vectors[pos.fill_null(0).to_numpy(zero_copy_only=False)]
        mixed = mix_last(np.zeros_like(value), key, value)
        mixed[~some] = 0.0
        return _finished(mixed, decimals)

    return vectors


def _summed_cells(key_vectors: np.ndarray, exp_weight: float, decay: float, decimals: int | None, numeric: str):
    length = key_vectors.shape[1]

    @F.arrow_udf("array<double>")
    def vectors(pos: pa.Array, num: pa.Array, txt: pa.Array) -> pa.Array:
        sizes = pos.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        place, num, txt = pos.flatten().to_numpy(zero_copy_only=False), num.flatten(), txt.flatten()
        out = np.zeros((len(sizes), length))
        for rows, cells in _portions(sizes):
            value = _values(num[cells], txt[cells], length, exp_weight, decay, numeric)
            out[rows] = _row_sums(mix_sum(np.zeros_like(value), key_vectors[place[cells]], value), sizes[rows])
        return _finished(out, decimals)

    return vectors


def _row_sums(cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), cells.shape[1]))
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
    out[filled] = np.add.reduceat(cells, starts, axis=0)
    return out


def wide(fingerprints: DataFrame, key: str, length: int = LENGTH) -> DataFrame:
    """The flat table form: key, statement count, one column per component."""
    return fingerprints.select(key, "statements", *[F.get("fp", i).alias(f"c{i}") for i in range(length)])


# --- nested documents ----------------------------------------------------------------

_STATEMENT = T.StructType([
    T.StructField("parent", T.StringType()), T.StructField("key", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("txt", T.StringType())
])


class _Whole(float):
    """A whole number of a document. One beyond the range of reals is infinite, and then has a vector of zeros."""


def _is_kept(value) -> bool:
    """Whole numbers and booleans always, reals unless 0, texts, lists and objects unless empty; never null."""
    if value is None:
        return False
    if isinstance(value, (bool, _Whole)):
        return True
    return value != 0 if isinstance(value, float) else len(value) > 0


def _parsed(text: str):
    """A JSON document as dicts and lists; the standard parser's, or for a document too deep for it :func:`_parsed_deep`'s."""
    try:
        return json.loads(text, parse_int=_Whole, parse_constant=_refuse)
    except RecursionError:
        return _parsed_deep(text)


_TOKENS = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+))', re.DOTALL)


def _parsed_deep(text: str):
    """The same without recursion, token by token: containers that are open wait in a list."""
    # What is open, outermost first: container and the key that waits for its value; what may come next.
    stack: list[list] = []
    top, expect, at = None, "value", 0
    while expect != "end":
        token = _TOKENS.match(text, at)
        if not token:
            raise ValueError(f"no JSON at character {at}")
        at = token.end()
        mark, scalar = token.groups()
        if scalar is not None and expect in ("key", "key or }"):
            stack[-1][1], expect = json.loads(scalar), ":"
            if not isinstance(stack[-1][1], str):
                raise ValueError(f"no key at character {at}")
            continue
        if mark == ":" and expect == ":":
            expect = "value"
            continue
        if mark == "," and expect == ", or close":
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if mark and mark in "}]":
            if expect not in (", or close", "key or }" if mark == "}" else "value or ]") or isinstance(stack[-1][0], dict) != (mark == "}"):
                raise ValueError(f"{mark} too early at character {at}")
            stack.pop()
        elif expect in ("value", "value or ]") and (scalar is not None or mark in ("{", "[")):
            value = json.loads(scalar, parse_int=_Whole, parse_constant=_refuse) if scalar is not None else {} if mark == "{" else []
            if not stack:
                top = value
            elif isinstance(stack[-1][0], dict):
                stack[-1][0][stack[-1][1]] = value
            else:
                stack[-1][0].append(value)
            if scalar is None:
                stack.append([value, None])
                expect = "key or }" if mark == "{" else "value or ]"
                continue
        else:
            raise ValueError(f"{mark or scalar!r} too early at character {at}")
        expect = ", or close" if stack else "end"
    if text[at:].strip():
        raise ValueError(f"more than one value at character {at}")
    return top


def _document_levels(text: str) -> list[list[tuple]]:
    """Kept statements of each level, walked once; a level's objects stand in the order of the level before."""
    top = _parsed(text)
    if not isinstance(top, dict):
        raise ValueError(f"not a JSON object: {text[:80]!r}")
    levels, objects = [], [("root", top)]
    while objects:
        level, inner = [], []
        for parent, fields in objects:
            for name, value in fields.items():
                if not _is_kept(value):
                    continue
                num = txt = None
                if isinstance(value, dict):
                    num = float(sum(map(_is_kept, value.values())))
                    inner.append((name, value))
                elif isinstance(value, str):
                    txt = value
                elif not isinstance(value, list):
                    num = float(value)
                level.append((parent, name, num, txt))
        if level or not levels:
            levels.append(level)
        objects = inner
    return levels


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON number")


@F.udf(T.ArrayType(T.ArrayType(_STATEMENT)), useArrow=True)
def _levels(text: str | None):
    return None if text is None else _document_levels(text)


def nested_statements(df: DataFrame, key: str, doc: str) -> DataFrame:
    """``(key, levels)``: the kept statements ``(parent, key, num, txt)`` of each level of a JSON document.

    An object met as a value is replaced by the number of its own kept fields;
    lists are leaves without a number or text. At the outermost level the order
    is that of the document, and a repeated key keeps its first place and its
    last value. Documents are parsed once and walked level by level in linear time, to any depth. A number of any length
    is one: beyond the range of reals it is infinite, is kept, and has a value vector of zeros. Text that is no JSON object fails
    the job; a null document has a null result.
    """
    return df.select(key, _levels(F.col(doc)).alias("levels"))


def nested_triples(df: DataFrame, key: str, doc: str) -> DataFrame:
    """Statement triples of every level: ``(key, depth, parent, name, num, txt)``."""
    levels = nested_statements(df, key, doc)
    # The outer forms, filtered afterwards: a plain explode makes the optimizer test the
    # size of its input first, which here would compute every document several times.
    rows = levels.select(key, F.posexplode_outer("levels").alias("depth", "level")).select(key, "depth", F.explode_outer("level").alias("s"))
    return rows.where("s IS NOT NULL").select(
        key, "depth", F.col("s.parent").alias("parent"), F.col("s.key").alias("name"), F.col("s.num").alias("num"), F.col("s.txt").alias("txt")
    )


def fingerprint_nested(
    df: DataFrame,
    key: str,
    doc: str,
    length: int = LENGTH,
    combine: str = "last",
    decimals: int | None = 3,
    exp_weight: float = EXPONENT_WEIGHT,
    decay: float = STRING_DECAY,
    numeric: str = "ME",
) -> DataFrame:
    """Fingerprint of a JSON document column.

    Outer statements come after inner ones, so with ``last`` the last kept field
    of the outermost object decides. A field inside another has its parent's key
    vector as base; at the outermost level the base is zeros.
    """
    levels = nested_statements(df, key, doc)
    size = F.aggregate("levels", F.lit(0), lambda acc, level: acc + F.size(level))
    if combine == "last":
        cells = F.filter(F.array(F.try_element_at(F.get("levels", 0), F.lit(-1))), lambda c: c.isNotNull())
        outer = F.lit(1)
    elif combine == "sum":
        cells = F.flatten("levels")
        outer = F.size(F.get("levels", 0))
    else:
        raise ValueError(f"unknown combine {combine!r}")
    rows = levels.select(key, size.alias("statements"), cells.alias("cells"), outer.alias("outer"))
    rows = rows.select(key, "statements", "outer", *[F.transform("cells", lambda c: c[f]).alias(f) for f in ("parent", "key", "num", "txt")])
    vectors = _nested_cells(length, exp_weight, decay, decimals, combine, numeric)("outer", "parent", "key", "num", "txt")
    return rows.select(key, "statements", vectors.alias("fp"))


def _nested_cells(length: int, exp_weight: float, decay: float, decimals: int | None, combine: str, numeric: str):
    """Vectors of documents from their statements; the first ``outer`` of a row stand at the outermost level."""
    mix = mix_last if combine == "last" else mix_sum

    @F.arrow_udf("array<double>")
    def vectors(outer: pa.Array, parent: pa.Array, key: pa.Array, num: pa.Array, txt: pa.Array) -> pa.Array:
        sizes = key.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        first = outer.fill_null(0).to_numpy(zero_copy_only=False)
        parent, key, num, txt = parent.flatten(), key.flatten(), num.flatten(), txt.flatten()
        out = np.zeros((len(sizes), length))
        for rows, cells in _portions(sizes):
            own = sizes[rows]
            place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            base = text_vectors(parent[cells], length, decay)
            base[place < np.repeat(first[rows], own)] = 0.0
            value = _values(num[cells], txt[cells], length, exp_weight, decay, numeric)
            out[rows] = _row_sums(mix(base, text_vectors(key[cells], length, decay), value), own)
        return _finished(out, decimals)

    return vectors
