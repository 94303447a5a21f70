"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def composite_key(columns: Sequence[str], sep: str = "") -> Column:
    """Concatenate columns into one key; null when any part is null.

    Without a separator, ``("a", "bc")`` and ``("ab", "c")`` give the same key.
    """
    parts: list[Column] = []
    for i, name in enumerate(columns):
        if i and sep:
            parts.append(F.lit(sep))
        parts.append(F.col(name).cast("string"))
    return F.concat(*parts)


def round_half_even(x: Column, digits: int) -> Column:
    """Scale, round to the even integer, scale back: the rule of array libraries."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def decimal_text(x: Column) -> Column:
    """A number with two decimals as text, one trailing zero dropped (``10.0``, ``17.14``)."""
    return F.regexp_replace(x.cast("decimal(38,2)").cast("string"), "0$", "")


def join_numbers(columns: Sequence[Column], sep: str = ", ") -> Column:
    """Join numbers into one text cell; null when any is null."""
    parts: list[Column] = []
    for i, c in enumerate(columns):
        if i:
            parts.append(F.lit(sep))
        parts.append(decimal_text(c))
    return F.concat(*parts)


def split_numbers(text: Column, count: int, sep: str = ", ") -> list[Column]:
    """Split a text cell into ``count`` doubles."""
    pieces = F.split(text, sep, count)
    return [F.get(pieces, i).cast("double") for i in range(count)]


def is_real(x: Column, dtype: str) -> Column:
    """Not null and, for floating types, not NaN."""
    present = x.isNotNull()
    return present & ~F.isnan(x) if dtype in ("float", "double") else present


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def vector_mean(v: Column) -> Column:
    return vector_sum(v) / F.size(v)


def unit_sum(v: Column) -> Column:
    """Shift a vector to minimum 0 and scale it to sum 1; a constant vector gives zeros."""

    def scaled(shifted: Column) -> Column:
        return let(
            vector_sum(shifted),
            lambda total: F.when(total != 0, F.transform(shifted, lambda x: x / total)).otherwise(shifted),
        )

    return let(v, lambda a: let(F.array_min(a), lambda low: let(F.transform(a, lambda x: x - low), scaled)))


def zscore(v: Column) -> Column:
    """Centre a vector and divide by its population deviation; null when that is 0."""

    def standardised(centred: Column) -> Column:
        spread = F.sqrt(vector_sum(F.transform(centred, lambda x: x * x)) / F.size(centred))
        return let(spread, lambda s: F.when(s > 0, F.transform(centred, lambda x: x / s)))

    return let(v, lambda a: let(vector_mean(a), lambda m: let(F.transform(a, lambda x: x - m), standardised)))


def lookup(values: Sequence, index: Column) -> Column:
    """Element of a short list of numbers by position; null outside it."""
    return F.get(F.expr(f"array({', '.join(repr(v) for v in values)})"), index)
