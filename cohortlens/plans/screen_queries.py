"""Two-group screens: profiles, counts, 2x2 tables, chi-square, enrichment, histograms, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import cohort as co
from cohortlens.operators import frames as fr
from cohortlens.operators import overlay as ov
from cohortlens.operators import screen as sc
from cohortlens.plans.cohort_queries import COHORT_CTES, COHORT_VIEWS, cohort_ids
from cohortlens.plans.registry import query, rounded, rounded_sql
from cohortlens.plans.views import LABS, Study, with_views
from cohortlens.session import materialize

VIEWS = (*COHORT_VIEWS, "fx_labs", "fx_groups")
_MEMBERS = (
    f"{COHORT_CTES}, fx_members AS (SELECT l.*, g.cluster FROM fx_ids JOIN fx_labs l USING (patient_id) JOIN fx_groups g USING (patient_id))"
)
_COUNTS = _MEMBERS + ", fx_counts AS (" + " UNION ALL ".join(
    f"SELECT '{lab}' AS lab, cluster, CAST(count(CASE WHEN {lab} = 1 THEN 1 END) AS BIGINT) AS high, "
    f"CAST(count(CASE WHEN {lab} = 0 THEN 1 END) AS BIGINT) AS low FROM fx_members GROUP BY cluster"
    for lab in LABS
) + ")"
_TABLES = _COUNTS + (
    ", fx_tables AS (SELECT lab, "
    + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN cluster = {g} THEN {m} END), 0) AS BIGINT) AS {m}_{g}" for m in ("high", "low") for g in (0, 1)
    )
    + " FROM fx_counts GROUP BY lab)"
)
_EXPECTED = _TABLES + (
    ", fx_expected AS (SELECT *, "
    "((high_0 + high_1)::DOUBLE * (high_0 + low_0)::DOUBLE) / (high_0 + high_1 + low_0 + low_1)::DOUBLE AS exp_high_0, "
    "((high_0 + high_1)::DOUBLE * (high_1 + low_1)::DOUBLE) / (high_0 + high_1 + low_0 + low_1)::DOUBLE AS exp_high_1, "
    "((low_0 + low_1)::DOUBLE * (high_0 + low_0)::DOUBLE) / (high_0 + high_1 + low_0 + low_1)::DOUBLE AS exp_low_0, "
    "((low_0 + low_1)::DOUBLE * (high_1 + low_1)::DOUBLE) / (high_0 + high_1 + low_0 + low_1)::DOUBLE AS exp_low_1 FROM fx_tables)"
)


def _terms(yates: bool) -> str:
    def term(cell: str) -> str:
        gap = f"abs(exp_{cell} - {cell}::DOUBLE)"
        gap = f"({gap} - least(0.5::DOUBLE, {gap}))" if yates else gap
        return f"{gap} * {gap} / exp_{cell}"

    return " + ".join(term(c) for c in sc.CELLS)


def _stats(yates: bool) -> str:
    sound = "exp_high_0 > 0 AND exp_high_1 > 0 AND exp_low_0 > 0 AND exp_low_1 > 0"
    return _EXPECTED + f", fx_chi AS (SELECT *, CASE WHEN {sound} THEN {_terms(yates)} END AS chi_stat, CASE WHEN {sound} THEN 1 END AS dof FROM fx_expected)"


_CHI = _stats(True)
_EXP_COLUMNS = ", ".join(f"{rounded_sql(f'exp_{c}')} AS exp_{c}" for c in sc.CELLS)


def counts(study: Study) -> DataFrame:
    """Counts over the cohort's lab columns in its two fixed groups. Unwanted columns go first, to keep the plans short."""
    labs = fr.drop_matching(fr.slice_columns(study.labs(), 1, key="patient_id"), ["first", "last", "neg", "pos"])
    members = co.inner(co.inner(cohort_ids(study), labs, "patient_id"), study.groups(), "patient_id")
    return sc.high_low_counts(members, "cluster", LABS)


def screened(study: Study, correction: bool = True, p_value: bool = False) -> DataFrame:
    return sc.chi2_screen(sc.contingency(counts(study), "cluster"), correction, p_value)


def _chi_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "lab", *sc.CELLS, rounded(F.col("chi_stat")).alias("chi_stat"), "dof",
        *[rounded(F.col(f"exp_{c}")).alias(f"exp_{c}") for c in sc.CELLS],
    )


_PROFILE = _MEMBERS + ", fx_profile AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n FROM fx_members WHERE cluster = 0"
    for lab in LABS for c in (lab, f"{lab}_first", f"{lab}_last", f"{lab}_neg", f"{lab}_pos")
) + ")"


def profile(study: Study, cluster: int) -> DataFrame:
    """Non-null counts in one cluster."""
    members = co.inner(cohort_ids(study), study.labs(), "patient_id")
    inside = co.inner(members, fr.cluster_members(study.groups(), cluster, "patient_id"), "patient_id")
    names = [c for c in inside.columns if c not in ("patient_id", "cluster", "n_encounters")]
    return fr.column_profile(inside, names)


@query("column_profile", with_views(f'{_PROFILE} SELECT "column", n FROM fx_profile', *VIEWS))
def column_profile(study: Study) -> DataFrame:
    return profile(study, 0)


@query("column_profile_by_cluster", with_views(_MEMBERS + ' SELECT * FROM (' + " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n FROM fx_members GROUP BY cluster"
    for lab in LABS for c in (lab, f"{lab}_first", f"{lab}_last", f"{lab}_neg", f"{lab}_pos")
) + ")", *VIEWS))
def column_profile_by_cluster(study: Study) -> DataFrame:
    """Both clusters in one pass."""
    inside = co.inner(co.inner(cohort_ids(study), study.labs(), "patient_id"), study.groups(), "patient_id")
    names = [c for c in inside.columns if c not in ("patient_id", "cluster", "n_encounters")]
    return fr.column_profile(inside, names, group="cluster")


@query("column_profile_pruned", with_views(
    f"""{_PROFILE} SELECT "column", n FROM fx_profile WHERE "column" NOT LIKE '%member%' AND "column" NOT LIKE '%first%'
    AND "column" NOT LIKE '%last%' AND "column" NOT LIKE '%neg%' AND "column" NOT LIKE '%pos%'""", *VIEWS))
def column_profile_pruned(study: Study) -> DataFrame:
    return fr.drop_matching_rows(profile(study, 0), "column", ["member", "first", "last", "neg", "pos"])


@query("labs_kept_by_profile", with_views(f"SELECT patient_id, {', '.join(LABS)} FROM fx_labs", "fx_labs"))
def labs_kept_by_profile(study: Study) -> DataFrame:
    """Keep the columns that a pruned profile lists; their names need no count."""
    labs = study.labs()
    words = ["member", "first", "last", "neg", "pos"]
    return fr.select_listed(labs, fr.drop_matching(labs.select(*labs.columns[2:]), words).columns, key="patient_id")


def _histogram_sql(source: str, integer: bool) -> str:
    """Automatic bins over a one-column relation ``fx_values(v)``."""
    floor_width = "greatest(w, 1.0::DOUBLE)" if integer else "w"
    return f"""{source}, fx_stats AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, count(v) AS n,
      quantile_cont(v::DOUBLE, 0.25) AS q1, quantile_cont(v::DOUBLE, 0.75) AS q3 FROM fx_values),
    fx_width AS (SELECT *, CASE WHEN q3 > q1 THEN least((hi - lo) / (log2(n) + 1.0::DOUBLE), 2.0::DOUBLE * (q3 - q1) / pow(n, 1.0::DOUBLE / 3.0::DOUBLE))
      ELSE (hi - lo) / (log2(n) + 1.0::DOUBLE) END AS w FROM fx_stats),
    fx_bins AS (SELECT *, CAST(ceil((hi - lo) / {floor_width}) AS INTEGER) AS k FROM fx_width),
    fx_step AS (SELECT *, (hi - lo) / k AS step FROM fx_bins),
    fx_hits AS (SELECT CAST(least(floor((v::DOUBLE - lo) / step), k - 1) AS INTEGER) AS bin, count(*) AS n FROM fx_values, fx_step WHERE v IS NOT NULL GROUP BY 1),
    fx_edges AS (SELECT CAST(unnest(range(0, k)) AS INTEGER) AS bin, lo, step FROM fx_step)
    SELECT e.bin, {rounded_sql('lo + e.bin * step')} AS low, {rounded_sql('lo + (e.bin + 1) * step')} AS high, CAST(coalesce(h.n, 0) AS BIGINT) AS n
    FROM fx_edges e LEFT JOIN fx_hits h USING (bin)"""


def _histogram(df: DataFrame, column: str) -> DataFrame:
    out = sc.auto_histogram(df, column, filled=False)
    return out.select(F.col("bin").cast("int").alias("bin"), rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"), "n")


@query("profile_histogram", with_views(_histogram_sql(f"{_PROFILE}, fx_values AS (SELECT n AS v FROM fx_profile)", True), *VIEWS))
def profile_histogram(study: Study) -> DataFrame:
    # The histogram takes several passes over a frame with one row per column.
    return _histogram(materialize(profile(study, 0), "profile"), "n")


_BOTH = _MEMBERS + ", fx_both AS (" + " UNION ALL ".join(
    f"SELECT cluster, CAST(count({c}) AS BIGINT) AS n FROM fx_members GROUP BY cluster"
    for lab in LABS for c in (lab, f"{lab}_first", f"{lab}_last", f"{lab}_neg", f"{lab}_pos")
) + ") " + " UNION ALL ".join(
    f"SELECT CAST({c} AS INTEGER) AS cluster, * FROM ({_histogram_sql(f'WITH fx_values AS (SELECT n AS v FROM fx_both WHERE cluster = {c})', True)})" for c in (0, 1)
)


@query("profile_histogram_by_cluster", with_views(_BOTH, *VIEWS))
def profile_histogram_by_cluster(study: Study) -> DataFrame:
    """The histograms of both clusters' profiles, each with bins of its own."""
    both = materialize(column_profile_by_cluster(study), "profile")
    parts = [_histogram(both.where(F.col("cluster") == c), "n").select(F.lit(c).alias("cluster"), "bin", "low", "high", "n") for c in (0, 1)]
    return parts[0].unionAll(parts[1])


@query("price_histogram", _histogram_sql("WITH fx_values AS (SELECT o_totalprice AS v FROM orders)", False))
def price_histogram(study: Study) -> DataFrame:
    return _histogram(study.table("orders").select("o_totalprice"), "o_totalprice")


@query("price_histogram_filled", "WITH fx_all AS (" + _histogram_sql("WITH fx_values AS (SELECT pow(o_totalprice / 1000, 4) AS v FROM orders)", False) + ") SELECT * FROM fx_all WHERE n > 0")
def price_histogram_filled(study: Study) -> DataFrame:
    """A heavy tail: the default, bins with rows only."""
    out = sc.auto_histogram(study.table("orders").select(F.pow(F.col("o_totalprice") / 1000, F.lit(4)).alias("v")), "v")
    return out.select(F.col("bin").cast("int").alias("bin"), rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"), "n")


@query("high_low_counts", with_views(f"{_COUNTS} SELECT lab, cluster, high, low FROM fx_counts", *VIEWS))
def high_low_counts(study: Study) -> DataFrame:
    return counts(study)


@query("contingency", with_views(f"{_TABLES} SELECT lab, {', '.join(sc.CELLS)} FROM fx_tables", *VIEWS))
def contingency(study: Study) -> DataFrame:
    return sc.contingency(counts(study), "cluster")


_CHI_SELECT = f"SELECT lab, {', '.join(sc.CELLS)}, {rounded_sql('chi_stat')} AS chi_stat, dof, {_EXP_COLUMNS} FROM fx_chi"


@query("chi2_screen", with_views(f"{_CHI} {_CHI_SELECT}", *VIEWS))
def chi2_screen(study: Study) -> DataFrame:
    return _chi_columns(screened(study))


@query("chi2_array_cells", with_views(
    f"{_CHI} SELECT lab, " + ", ".join(f"{c}::DOUBLE AS observed_{i}, {rounded_sql(f'exp_{c}')} AS expected_{i}" for i, c in enumerate(sc.CELLS)) + " FROM fx_chi", *VIEWS))
def chi2_array_cells(study: Study) -> DataFrame:
    """The cells as arrays, spelled out."""
    found = sc.with_array_cells(screened(study))
    return found.select("lab", *[x for i in range(4) for x in (F.get("observed", i).alias(f"observed_{i}"), rounded(F.get("expected", i)).alias(f"expected_{i}"))])


@query("chi2_screen_uncorrected", with_views(f"{_stats(False)} {_CHI_SELECT}", *VIEWS))
def chi2_screen_uncorrected(study: Study) -> DataFrame:
    return _chi_columns(screened(study, correction=False))


@query("chi2_one_lab", with_views(f"{_CHI} {_CHI_SELECT} WHERE lab = 'lab_Brand1'", *VIEWS))
def chi2_one_lab(study: Study) -> DataFrame:
    tables = sc.contingency(counts(study), "cluster")
    return _chi_columns(sc.chi2_screen(fr.point_lookup(tables, "lab", "lab_Brand1"), p_value=False))


# erfc by the all-positive series erf(z) = exp(-z^2) * sum z^(2n+1) / gamma(n + 3/2)
_PVAL = (
    "CASE WHEN chi_stat = 0 THEN 1.0::DOUBLE WHEN chi_stat > 0 THEN 1.0::DOUBLE - exp(-chi_stat / 2) * "
    "list_sum(list_transform(range(0, 400), lambda n: exp((2 * n + 1) * ln(sqrt(chi_stat / 2)) - lgamma(n + 1.5)))) END"
)


@query("chi2_pvalues", with_views(f"{_CHI} SELECT lab, {rounded_sql('chi_stat')} AS chi_stat, {rounded_sql(_PVAL)} AS pval FROM fx_chi", *VIEWS))
def chi2_pvalues(study: Study) -> DataFrame:
    found = screened(study, p_value=True)
    return found.select("lab", rounded(F.col("chi_stat")).alias("chi_stat"), rounded(F.col("pval")).alias("pval"))


_RANKED = (
    f"{_CHI} SELECT CAST(row_number() OVER (ORDER BY chi_stat DESC NULLS LAST, lab) - 1 AS INTEGER) AS rank, lab, "
    f"{rounded_sql('chi_stat')} AS chi_stat, {rounded_sql(_PVAL)} AS pval, dof, "
    "concat(high_0, '.0, ', high_1, '.0, ', low_0, '.0, ', low_1, '.0') AS observed, "
    + " || ', ' || ".join(f"CAST(round_even(exp_{c} * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS VARCHAR)" for c in sc.CELLS)
    + " AS expctd FROM fx_chi"
)


@query("chi2_ranked", with_views(_RANKED, *VIEWS))
def chi2_ranked(study: Study) -> DataFrame:
    """The flagship: every lab of the cohort screened between two groups, strongest first."""
    ranked = fr.rank_desc(sc.with_text_cells(screened(study, p_value=True)), "chi_stat", "lab")
    return ranked.select(
        "rank", "lab", rounded(F.col("chi_stat")).alias("chi_stat"), rounded(F.col("pval")).alias("pval"), "dof", "observed", "expctd"
    )


@query("enrichment", with_views(
    f"{_CHI} SELECT lab, " + ", ".join(f"{rounded_sql(f'{c}::DOUBLE / exp_{c}')} AS ratio_{c}" for c in sc.CELLS) + " FROM fx_chi", *VIEWS))
def enrichment(study: Study) -> DataFrame:
    found = sc.enrichment(screened(study))
    return found.select("lab", *[rounded(F.col(f"ratio_{c}")).alias(f"ratio_{c}") for c in sc.CELLS])


@query("enrichment_from_text", with_views(
    f"{_CHI} SELECT lab, "
    + ", ".join(f"{rounded_sql(f'{c}::DOUBLE / (round_even(exp_{c} * 100.0::DOUBLE, 0) / 100.0::DOUBLE)')} AS ratio_{c}" for c in sc.CELLS)
    + " FROM fx_chi", *VIEWS))
def enrichment_from_text(study: Study) -> DataFrame:
    """The same ratios read back from the comma-joined cells, which hold two decimals."""
    cells = fr.select(sc.with_text_cells(screened(study)), ["lab", "observed", "expctd"])
    return sc.ratios_from_text(cells).select("lab", *[rounded(F.col(f"ratio_{c}")).alias(f"ratio_{c}") for c in sc.CELLS])


# --- overlays ------------------------------------------------------------------------

RULES = [("both", ["dx_urgent", "dx_low"]), ("urgent", ["dx_urgent"]), ("low", ["dx_low"])]
_MARKED = (
    "WITH fx_marked AS (SELECT patient_id, g.cluster, CASE WHEN dx_urgent = 1 AND dx_low = 1 THEN 'both' "
    "WHEN dx_urgent = 1 THEN 'urgent' WHEN dx_low = 1 THEN 'low' END AS marker FROM fx_groups g JOIN fx_diag USING (patient_id))"
)


@query("overlay_markers", with_views(f"{_MARKED} SELECT patient_id, cluster, marker FROM fx_marked", "fx_groups", "fx_diag"))
def overlay_markers(study: Study) -> DataFrame:
    return ov.overlay(study.groups(), study.diagnoses(), "patient_id", RULES).select("patient_id", "cluster", "marker")


@query("overlay_counts", with_views(f"{_MARKED} SELECT cluster, marker, CAST(count(*) AS BIGINT) AS n FROM fx_marked GROUP BY cluster, marker", "fx_groups", "fx_diag"))
def overlay_counts(study: Study) -> DataFrame:
    return ov.overlay_counts(ov.overlay(study.groups(), study.diagnoses(), "patient_id", RULES))


@query("overlay_both", with_views(f"{_MARKED} SELECT patient_id, cluster FROM fx_marked WHERE marker = 'both'", "fx_groups", "fx_diag"))
def overlay_both(study: Study) -> DataFrame:
    marked = co.inner(study.groups(), fr.where_all_flags(study.diagnoses(), ["dx_urgent", "dx_low"]), "patient_id")
    return marked.select("patient_id", "cluster")
