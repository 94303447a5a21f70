"""Projections, filters, simple aggregates, ranking and set union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import composite_key, is_real

# --- projections ---------------------------------------------------------------------


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def with_key(df: DataFrame, name: str, parts: Sequence[str], sep: str = "") -> DataFrame:
    """Add a composite key column."""
    return df.withColumn(name, composite_key(parts, sep))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def drop_matching(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Drop the columns whose name contains any of ``words`` (case-sensitive)."""
    return df.select(*[c for c in df.columns if not any(w in c for w in words)])


def drop_matching_rows(df: DataFrame, name_column: str, words: Sequence[str]) -> DataFrame:
    """The same rule applied to names held in a column."""
    keep = F.lit(True)
    for word in words:
        keep = keep & ~F.col(name_column).contains(word)
    return df.where(keep)


def slice_columns(df: DataFrame, start: int | None, stop: int | None = None, key: str | None = None) -> DataFrame:
    """Columns by position. ``key`` is kept in front and is not counted."""
    rest = [c for c in df.columns if c != key]
    return df.select(*([key] if key else []), *rest[start:stop])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def dedup_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns that share a name."""
    seen: set[str] = set()
    unique, keep = [], []
    for i, name in enumerate(df.columns):
        fresh = name not in seen
        seen.add(name)
        unique.append(f"_dup{i}" if not fresh else name)
        if fresh:
            keep.append(name)
    return df.toDF(*unique).select(*keep)


def select_listed(df: DataFrame, names: Sequence[str], key: str | None = None) -> DataFrame:
    """Keep the columns named in ``names`` (and the key), in the order of ``df``."""
    wanted = set(names)
    return df.select(*[c for c in df.columns if c == key or c in wanted])


def to_documents(df: DataFrame, key: str, column: str = "doc") -> DataFrame:
    """One JSON document per row: every column but the key, nulls kept."""
    fields = F.struct(*[c for c in df.columns if c != key])
    return df.select(key, F.to_json(fields, {"ignoreNullFields": "false"}).alias(column))


# --- filters -------------------------------------------------------------------------


def where_true(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose boolean flag is true; false and null go."""
    return df.where(F.col(flag))


def where_present(df: DataFrame, column: str) -> DataFrame:
    """Rows that have a value. (Comparing with null by ``!=`` would keep none.)"""
    return df.where(F.col(column).isNotNull())


def where_flag(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.col(flag) == 1)


def where_all_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    for flag in flags:
        df = where_flag(df, flag)
    return df


def drop_nan_key(df: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is null or NaN. Spark holds NaN equal to itself, so ``k = k`` is no test."""
    return df.where(is_real(F.col(key), dict(df.dtypes)[key]))


def cluster_members(df: DataFrame, cluster: int, key: str, column: str = "cluster") -> DataFrame:
    return df.where(F.col(column) == cluster).select(key)


def where_longer(df: DataFrame, array: str, n: int) -> DataFrame:
    """Rows whose array column has more than ``n`` elements."""
    return df.where(F.size(array) > n)


def keys_with_more(df: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """The same question on one row per item, so that no array per key is ever built."""
    return (
        df.select(key, item)
        .distinct()
        .groupBy(key)
        .agg(F.count(item).alias("n_items"))
        .where(F.col("n_items") > n)
    )


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


# --- aggregates ----------------------------------------------------------------------


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def first_non_null(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Per key, the first non-null value of every other column in the stated order.

    Ties in the order are settled by the value itself. Each minimum merges
    before the shuffle, so a key with many rows costs one row per task.
    """
    def first(name: str) -> Column:
        ordered = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], F.col(name).alias("v"))
        return F.min(F.when(F.col(name).isNotNull(), ordered))["v"].alias(name)

    return df.groupBy(key).agg(*[first(c) for c in df.columns if c != key])


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, group: str | None = None) -> DataFrame:
    """Non-null count per column as ``(column, n)``, with ``group`` for each of its values, in one pass.

    The wide rows are counted as they are; the turn to long form happens on one row per group.
    """
    by = [group] if group else []
    names = [c for c in columns or df.columns if c != group]
    counts = df.groupBy(*by).agg(*[F.expr(f"count(`{c}`) AS `{c}`") for c in names])
    return counts.unpivot(by, names, "column", "n")


def shape(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


# --- order, caps, union --------------------------------------------------------------


def rank_desc(df: DataFrame, column: str, tie: str, name: str = "rank") -> DataFrame:
    """Sort descending and number the rows from 0, nulls last, ties by ``tie``.

    A total number needs one task, so this is for results with one row per
    column of a table, never for the table itself.
    """
    order = Window.orderBy(F.desc_nulls_last(column), F.asc(tie))
    return df.withColumn(name, F.row_number().over(order) - 1)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def first_record(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key).limit(1)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Set union. Duplicates go once, after partial removal on each task."""
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df)
    return whole.distinct()
