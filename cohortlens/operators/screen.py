"""Two-group screen of every measurement: counts, 2x2 tables, chi-square, enrichment, histogram."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import join_numbers, let, round_half_even, split_numbers
from cohortlens.session import materialize

CELLS = ("high_0", "high_1", "low_0", "low_1")


def high_low_counts(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Per column and group, how many cells are 1 (``high``) and 0 (``low``).

    The wide rows are aggregated as they are, so only one short row per group
    and task is shuffled; the turn to long form happens on the totals.
    """
    totals = df.groupBy(group).agg(*[
        F.expr(f"named_struct('high', count_if(`{c}` = 1), 'low', count_if(`{c}` = 0)) AS `{c}`") for c in columns
    ])
    long = totals.unpivot([group], list(columns), "lab", "n")
    return long.select("lab", group, F.col("n.high").alias("high"), F.col("n.low").alias("low"))


def contingency(counts: DataFrame, group: str, groups: tuple = (0, 1)) -> DataFrame:
    """One 2x2 table per lab: high and low counts in the two groups, 0 where a group has no rows.

    Rows of further groups play no part; :func:`chi2_groups` takes any number of groups.
    """
    def cell(measure: str, value) -> Column:
        return F.coalesce(F.sum(F.when(F.col(group) == value, F.col(measure))), F.lit(0)).cast("long")

    return counts.groupBy("lab").agg(
        *[cell(m, g).alias(f"{m}_{i}") for m in ("high", "low") for i, g in enumerate(groups)]
    )


# Terms of the series and of the continued fraction; for up to some thousand degrees of freedom they are exact to rounding.
_TERMS = 400


def chi2_tail(stat: Column | str, dof: Column | int = 1) -> Column:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function ``Q(dof / 2, stat / 2)``.

    Below ``dof / 2 + 1`` from the series of the lower tail, above from the continued fraction, each folded over ``_TERMS`` terms.
    """
    stat = F.col(stat) if isinstance(stat, str) else stat
    dof = F.lit(dof) if isinstance(dof, int) else dof
    halves = F.struct((dof.cast("double") / 2).alias("a"), (stat.cast("double") / 2).alias("x"), dof.cast("int").alias("k"))

    def tail(p: Column) -> Column:
        a, x = p["a"], p["x"]
        # The gamma function of a whole or half number is a product that ends at 1 or at the root of pi.
        odd = F.when(p["k"] % 2 == 1, F.lit(math.log(math.pi) / 2)).otherwise(0.0)
        steps = F.filter(F.sequence(F.lit(0), F.floor((p["k"] - 1) / 2).cast("int")), lambda i: i > 0)
        log_gamma = F.aggregate(steps, odd, lambda total, i: total + F.log(a - i))
        front = F.exp(a * F.log(x) - x - log_gamma)
        terms = F.sequence(F.lit(1), F.lit(_TERMS))
        series = F.aggregate(
            terms, F.struct((1 / a).alias("term"), (1 / a).alias("total")),
            lambda s, n: let(s["term"] * x / (a + n), lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total"))), lambda s: s["total"],
        )

        def next_fraction(s: Column, n: Column) -> Column:
            top, low = n * (a - n), x + 2 * n + 1 - a
            d, c = 1 / (top * s["d"] + low), low + top / s["c"]
            return let(F.struct(d.alias("d"), c.alias("c")), lambda e: F.struct(e["d"].alias("d"), e["c"].alias("c"), (s["h"] * e["d"] * e["c"]).alias("h")))

        first = let(1 / (x + 1 - a), lambda d: F.struct(d.alias("d"), F.lit(1e300).alias("c"), d.alias("h")))
        fraction = F.aggregate(F.transform(terms, lambda n: n.cast("double")), first, next_fraction, lambda s: s["h"])
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return F.when(stat.isNotNull() & (dof > 0), let(halves, tail))


def chi2_tables(cells: DataFrame, by: str, row: str, column: str, n: str, p_value: bool = True) -> DataFrame:
    """``(by, chi_stat, dof, status[, pval])``: test of independence of each table, of any size, given as cells ``(by, row, column, n)``.

    Cells that are not there count 0, repeated ones are added up. Without correction; ``dof`` is ``(rows - 1)(columns - 1)``. A table
    with a row or column without counts, or with one row or column only, has no test, as ``status`` says. Sums
    are taken per table, row and column, so a table of any size is never in one task's memory.
    """
    cells = cells.groupBy(by, row, column).agg(F.sum(n).cast("double").alias("o"))
    rows = cells.groupBy(by, row).agg(F.sum("o").alias("row_total"))
    columns = cells.groupBy(by, column).agg(F.sum("o").alias("column_total"))
    sizes = rows.groupBy(by).agg(F.count("*").alias("r"), F.sum("row_total").alias("total"), F.min("row_total").alias("least_row"))
    sizes = sizes.join(columns.groupBy(by).agg(F.count("*").alias("c"), F.min("column_total").alias("least_column")), by)
    # The sum of (o - e)^2 / e is total * (sum of o^2 / (row * column) - 1); cells of 0 add nothing to it.
    parts = cells.where("o > 0").join(rows, [by, row]).join(columns, [by, column]).groupBy(by).agg(F.sum(F.col("o") * F.col("o") / F.col("row_total") / F.col("column_total")).alias("s"))
    sound = (F.col("least_row") > 0) & (F.col("least_column") > 0) & (F.col("r") > 1) & (F.col("c") > 1)
    out = sizes.join(parts, by, "left").select(
        by, F.when(sound, F.greatest(F.lit(0.0), F.col("total") * (F.col("s") - 1))).alias("chi_stat"),
        F.when(sound, (F.col("r") - 1) * (F.col("c") - 1)).cast("int").alias("dof"), F.when(sound, "ok").otherwise("degenerate").alias("status"),
    )
    return out.withColumn("pval", chi2_tail(F.col("chi_stat"), F.col("dof"))) if p_value else out


def chi2_groups(counts: DataFrame, group: str, p_value: bool = True) -> DataFrame:
    """:func:`chi2_tables` of each lab: high and low counts in all groups of :func:`high_low_counts`, however many."""
    cells = counts.unpivot(["lab", group], ["high", "low"], "level", "n")
    return chi2_tables(cells, "lab", "level", group, "n", p_value)


def chi2_screen(tables: DataFrame, correction: bool = True, p_value: bool = True) -> DataFrame:
    """Chi-square test of independence per 2x2 table.

    With ``correction`` each deviation is moved towards the expected count by
    at most 0.5 (Yates). A table with an expected count of 0, or without any
    rows, has no test: its statistic is null and ``status`` says so.
    """
    a, b, c, d = (F.col(x).cast("double") for x in CELLS)
    total = a + b + c + d
    expected = [
        F.try_divide((a + b) * (a + c), total),
        F.try_divide((a + b) * (b + d), total),
        F.try_divide((c + d) * (a + c), total),
        F.try_divide((c + d) * (b + d), total),
    ]
    step1 = tables.select("*", *[e.alias(f"exp_{cell}") for e, cell in zip(expected, CELLS)])
    wanted = [F.col(f"exp_{cell}") for cell in CELLS]
    sound = F.lit(True)
    for e in wanted:
        sound = sound & F.coalesce(e > 0, F.lit(False))

    def term(cell: str) -> Column:
        e, o = F.col(f"exp_{cell}"), F.col(cell).cast("double")
        gap = F.abs(e - o)
        if correction:
            gap = gap - F.least(F.lit(0.5), gap)
        return gap * gap / F.when(e > 0, e)

    stat = F.when(sound, sum((term(cell) for cell in CELLS[1:]), term(CELLS[0])))
    out = (
        step1.withColumn("chi_stat", stat)
        .withColumn("dof", F.when(sound, F.lit(1)))
        .withColumn("status", F.when(sound, "ok").otherwise("degenerate"))
    )
    return out.withColumn("pval", chi2_tail("chi_stat")) if p_value else out


def with_text_cells(screened: DataFrame) -> DataFrame:
    """Add the comma-joined ``observed`` and ``expctd`` cells (expected counts at two decimals)."""
    return screened.withColumn("observed", join_numbers([F.col(c) for c in CELLS])).withColumn(
        "expctd", join_numbers([round_half_even(F.col(f"exp_{c}"), 2) for c in CELLS])
    )


def with_array_cells(screened: DataFrame) -> DataFrame:
    """The typed form of the same cells."""
    return screened.withColumn("observed", F.array(*[F.col(c).cast("double") for c in CELLS])).withColumn(
        "expected", F.array(*[F.col(f"exp_{c}") for c in CELLS])
    )


def enrichment(screened: DataFrame) -> DataFrame:
    """Observed over expected, cell by cell; null where nothing was expected."""
    return screened.select(
        "*", *[F.try_divide(F.col(c).cast("double"), F.col(f"exp_{c}")).alias(f"ratio_{c}") for c in CELLS]
    )


def ratios_from_text(cells: DataFrame) -> DataFrame:
    """Observed over expected from the ``observed`` and ``expctd`` text cells."""
    observed, expected = (split_numbers(F.col(c), len(CELLS)) for c in ("observed", "expctd"))
    return cells.select(
        "*", *[F.try_divide(o, e).alias(f"ratio_{c}") for o, e, c in zip(observed, expected, CELLS)]
    )


# --- histogram -----------------------------------------------------------------------

_INTEGERS = {"tinyint", "smallint", "int", "bigint"}
# Steps of a search; one over the share of rows by which the sketch may miss a rank; bins that may be written out empty.
_SPLITS, _ACCURACY, MOST_BINS = 1024, 10_000, 1_000_000


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], low: float, high: float, times: str | None = None) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of a sorted column of finite numbers, without sorting it; a row stands for ``times`` of them.

    Each round counts rows in equal steps between two bounds and keeps the step
    that holds the rank, until a step holds one value. A round is one aggregate
    with a bounded result. A span is at most half of the one before: its width falls by
    ``_SPLITS``, or, where steps would be finer than numbers are, its few distinct values are counted one by one.
    """
    found: dict[int, float] = {}
    spans = {r: (low, high, r) for r in ranks}
    x = F.col(column).cast("double")
    while spans:
        tagged = []
        for lo, hi in {(lo, hi) for lo, hi, _ in spans.values()}:
            width = hi / _SPLITS - lo / _SPLITS
            finest = max(math.ulp(lo), math.ulp(hi))
            if width > finest:
                step = F.least(F.floor(x / F.lit(width) - F.lit(lo / width)), F.lit(_SPLITS - 1)).cast("double")
            else:
                step = x
            tagged.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), step.alias("step"))))
        hits = df.select(x.alias("x"), (F.col(times) if times else F.lit(1)).alias("times"), F.explode(F.array_compact(F.array(*tagged))).alias("s"))
        counted = hits.groupBy("s.lo", "s.hi", "s.step").agg(F.sum("times").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        steps: dict[tuple, list] = {}
        for row in counted.orderBy("a").collect():  # some _SPLITS rows for each rank
            steps.setdefault((row.lo, row.hi), []).append((row.n, row.a, row.b))
        for rank, (lo, hi, offset) in list(spans.items()):
            for n, a, b in steps[(lo, hi)]:
                if offset < n:
                    break
                offset -= n
            if a == b:
                found[rank] = a
                del spans[rank]
            else:
                spans[rank] = (a, b, offset)
    return found


def quartiles(values: DataFrame, column: str, n: int, around: Sequence[float]) -> tuple[float, float]:
    """The exact lower and upper quartile (linear between neighbours) of ``n`` finite numbers, in one scan.

    ``around`` are values that surely have the quartiles between them, two by two, from a sketch. Only the values
    there are kept, with their counts, and searched; of all others the number is enough.
    """
    x = F.col(column).cast("double")
    low, high, low3, high3 = around
    place = F.when(x < low, 0).when(x <= high, 1).when(x < low3, 2).when(x <= high3, 3).otherwise(4)
    kept = values.groupBy(place.alias("place"), F.when(place.isin(1, 3), x).alias("x")).agg(F.count("*").alias("times"))
    kept = materialize(kept, "quartiles")
    sizes = {r["place"]: r["n"] for r in kept.groupBy("place").agg(F.sum("times").alias("n")).collect()}
    out = []
    for q, own, ends in ((0.25, 1, (low, high)), (0.75, 3, (low3, high3))):
        before, at = sum(sizes.get(p, 0) for p in range(own)), q * (n - 1)
        if own == 3 and high >= low3:  # the two ranges meet: all values there are in the first
            own, ends, before = 1, (low, high), sizes.get(0, 0)
        ranks = sorted({math.floor(at) - before, math.ceil(at) - before})
        found = order_statistics(kept.where(F.col("place") == own), "x", ranks, *ends, times="times")
        first, last = found[ranks[0]], found[ranks[-1]]
        out.append(first + (last - first) * (at - math.floor(at)))
    return out[0], out[1]


def auto_histogram(df: DataFrame, column: str, filled: bool = True) -> DataFrame:
    """Histogram with the number of bins chosen from the data, in three scans.

    The bin width is the smaller of the Sturges and the Freedman-Diaconis
    widths, Sturges alone when the quartiles coincide, and at least 1 for
    integer columns. Bins are half-open, the last one closed. Null, NaN and infinite values take no part. A
    heavy tail makes many bins, most of them empty, so only those with rows are returned; with ``filled=False`` all
    are, as long as there are at most ``MOST_BINS``.
    """
    x = F.col(column).cast("double")
    values = df.where(F.col(column).isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    marks = [q + step for q in (0.25, 0.75) for step in (-2 / _ACCURACY, 2 / _ACCURACY)]
    stats = values.agg(F.min(column), F.max(column), F.count(column), F.percentile_approx(x, marks, _ACCURACY)).first()
    low, high, n, around = stats
    schema = "bin BIGINT, low DOUBLE, high DOUBLE, n BIGINT"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    low, high = float(low), float(high)
    spread = high - low
    if math.isinf(spread):
        raise ValueError("the range of the column is wider than a number can say")
    bins = 1
    if spread > 0:
        if around[1] >= around[2]:  # one range for both
            around = [around[0], around[3], around[3], around[3]]
        q1, q3 = quartiles(values, column, n, around)
        sturges = spread / (math.log2(n) + 1.0)
        freedman = 2.0 * (q3 - q1) / n ** (1.0 / 3.0)
        width = min(sturges, freedman) if freedman > 0 else sturges
        if dict(df.dtypes)[column] in _INTEGERS:
            width = max(width, 1.0)
        bins = math.ceil(spread / width) if width > 0 and spread / width < 2**62 else 1
    else:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    if step == 0:
        bins, step = 1, high - low
    at = F.least(F.floor((x - low) / F.lit(step)), F.lit(bins - 1)).cast("long")
    counted = values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    if not filled:
        if bins > MOST_BINS:
            raise ValueError(f"{bins} bins: take those with rows, filled=True")
        every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
        counted = every.join(counted, "bin", "left")
    return counted.select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(step)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(step)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
