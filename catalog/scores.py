"""Metrics, group reports, cross-condition tables, trends, top-k, report extracts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from strandframe.functions.codes import STRUCTURE_LABELS
from strandframe.operators import conditions as across
from strandframe.operators import groups, metrics, reports, trends
from strandframe.operators.ranking import aggregate_with_medians
from strandframe.sources.kept import Kept
from strandframe.sources.readers import union_tables

from .base import (
    CELL_KEYS, CELLS, HALF, MODELS, POSITIONS, RESULTS, ROW_KEYS, WIDE, YEARS,
    cells, fix, p_value_sql, positions, query, r, ra, results, table, wide, with_,
)

PREDICTIONS = {m: f"{m}_predicted" for m in MODELS}
_KEYS = ", ".join(CELL_KEYS)


def _per_model(select, source: str, by: str = "", models=MODELS) -> str:
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(f"SELECT {lead}'{m}' AS model, {select(m)} FROM {source}{tail}" for m in models)


# ---- alignment ---------------------------------------------------------------

_WIDE_COLUMNS = [
    c for y in YEARS for c in (f"actual_{y}", f"alpha_pred_{y}", f"beta_error_{y}", f"alpha_abs_error_{y}", f"beta_unc_{y}")
]
_ALIGN_SQL = with_(
    WIDE,
    f"SELECT {_KEYS}, secondary_structure_encoded, core_exterior_encoded, {ra('relative_accessibility', 'relative_accessibility', 6)}, "
    + ", ".join(ra(c, c) for c in _WIDE_COLUMNS) + " FROM wide",
)


def _fix_wide(df, columns):
    share = (F.floor(F.col("relative_accessibility") * 1e6 + HALF) / 1e6).alias("relative_accessibility")
    return df.select(
        *CELL_KEYS, "secondary_structure_encoded", "core_exterior_encoded", share,
        *[(F.floor(F.col(c) * 1e4 + HALF) / 1e4).alias(c) for c in columns],
    )


@query("j1_align_conditions", _ALIGN_SQL)
def _(spark, folder):
    return _fix_wide(wide(spark, folder), _WIDE_COLUMNS)


@query("j1_align_by_joins", _ALIGN_SQL)
def _(spark, folder):
    """The form for repeated keys: full outer joins, condition by condition."""
    joined = across.align_conditions(cells(spark, folder), YEARS, MODELS, unique_keys=False)
    return _fix_wide(joined, _WIDE_COLUMNS)


@query(
    "j1_repeated_keys_all",
    "WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS y FROM lineitem WHERE l_linestatus = 'O'), "
    "f AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS y FROM lineitem WHERE l_linestatus = 'F') "
    "SELECT coalesce(o.l_orderkey, f.l_orderkey) AS domain_id, coalesce(o.l_linenumber, f.l_linenumber) AS resid, coalesce(o.l_returnflag, f.l_returnflag) AS resname, "
    "o.y AS \"actual_O\", f.y AS \"actual_F\", o.y + 1 AS \"alpha_pred_O\", f.y + 1 AS \"alpha_pred_F\" "
    "FROM o FULL JOIN f ON o.l_orderkey = f.l_orderkey AND o.l_linenumber = f.l_linenumber AND o.l_returnflag = f.l_returnflag",
)
def _(spark, folder):
    """All of lineitem, by keys that repeat a few times within a condition."""
    long = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("domain_id"), F.col("l_linenumber").alias("resid"), F.col("l_returnflag").alias("resname"),
        F.col("l_linestatus").alias("condition"), F.col("l_quantity").alias("actual"), (F.col("l_quantity") + 1).alias("alpha_predicted"))
    paired = across.align_conditions(long, ["O", "F"], ["alpha"], unique_keys=False)
    return paired.select(*CELL_KEYS, "actual_O", "actual_F", "alpha_pred_O", "alpha_pred_F")


_DIFFS = [f"{k}_{y}" for y in YEARS for k in ("pred_diff", "abs_error_diff")]


@query(
    "j4_model_differences",
    with_(WIDE, f"SELECT {_KEYS}, " + ", ".join(
        ra(f"alpha_{'pred' if 'pred' in d else 'abs_error'}_{d[-4:]} - beta_{'pred' if 'pred' in d else 'abs_error'}_{d[-4:]}", d) for d in _DIFFS)
          + " FROM wide"),
)
def _(spark, folder):
    return fix(wide(spark, folder).select(*CELL_KEYS, *_DIFFS))


# ---- single-run metrics ------------------------------------------------------


def _pearson(a: str, b: str) -> str:
    return f"corr({a}, {b})"


def _r2_sql(y: str, p: str) -> str:
    return f"1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y}))"


def _metric_sql(m: str) -> dict[str, tuple[str, int]]:
    y, p = "actual", f"{m}_predicted"
    return {
        "rmse": (f"sqrt(avg(({y} - {p}) * ({y} - {p})))", 3),
        "mae": (f"avg(abs({y} - {p}))", 3),
        "r2": (_r2_sql(y, p), 6),
        "explained_variance": (f"1 - var_pop({y} - {p}) / var_pop({y})", 6),
        "pearson_correlation": (_pearson(y, p), 6),
        "max_error": (f"max(abs({y} - {p}))", 3),
        "median_absolute_error": (f"quantile_cont(abs({y} - {p}), 0.5)", 3),
        "adjusted_r2": (f"1 - (1 - ({_r2_sql(y, p)})) * (count(*) - 1) / (count(*) - 8 - 1)", 6),
        "root_mean_square_absolute_error": (f"sqrt(avg(abs({y} - {p}) ** 2))", 3),
        "temperature_coefficient": (_pearson(p, f"{y} * 320 / 400"), 6),
    }


for _id, _metric in {
    "a1_rmse": "rmse", "a2_mae": "mae", "a3_r2": "r2", "a4_explained_variance": "explained_variance",
    "a5_pearson": "pearson_correlation", "a7_max_error": "max_error", "a8_median_absolute_error": "median_absolute_error",
    "a9_adjusted_r2": "adjusted_r2", "a10_rms_absolute_error": "root_mean_square_absolute_error",
    "a12_temperature_coefficient": "temperature_coefficient",
}.items():
    def _metric_run(spark, folder, metric=_metric):
        rows = results(spark, folder)
        scored = metrics.regression_metrics(
            rows.persist() if "median" in metric else rows, "actual", PREDICTIONS, metrics=(metric,), n_features=8, condition=320)
        return fix(scored, _metric_sql("alpha")[metric][1])

    query(_id, with_(RESULTS, _per_model(lambda m, k=_metric: f"count(*) AS n, {ra(_metric_sql(m)[k][0], k, _metric_sql(m)[k][1])}", "results")))(_metric_run)


@query(
    "a6_spearman",
    with_(RESULTS + ", ranked AS (SELECT *, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2.0::DOUBLE AS ry, "
          + ", ".join(f"rank() OVER (ORDER BY {m}_predicted) + (count(*) OVER (PARTITION BY {m}_predicted) - 1) / 2.0::DOUBLE AS r{m}" for m in MODELS)
          + " FROM results)",
          _per_model(lambda m: f"count(*) AS n, {ra(f'corr(ry, r{m})', 'spearman_correlation', 6)}", "ranked")),
)
def _(spark, folder):
    rows = results(spark, folder).select("actual", *PREDICTIONS.values()).persist()
    return fix(metrics.regression_metrics(rows, "actual", PREDICTIONS, metrics=("spearman_correlation",)), 6)


@query(
    "a6_spearman_by_structure",
    with_(RESULTS + ", ranked AS (SELECT *, rank() OVER (PARTITION BY secondary_structure_encoded ORDER BY actual) "
          "+ (count(*) OVER (PARTITION BY secondary_structure_encoded, actual) - 1) / 2.0::DOUBLE AS ry, "
          "rank() OVER (PARTITION BY secondary_structure_encoded ORDER BY beta_predicted) "
          "+ (count(*) OVER (PARTITION BY secondary_structure_encoded, beta_predicted) - 1) / 2.0::DOUBLE AS rp FROM results)",
          "SELECT secondary_structure_encoded, count(*) AS n, " + ra("corr(ry, rp)", "spearman_correlation", 6) + " FROM ranked GROUP BY 1"),
)
def _(spark, folder):
    return fix(metrics.rank_correlation(
        results(spark, folder).select("actual", "beta_predicted", "secondary_structure_encoded").persist(), "actual", "beta_predicted", ["secondary_structure_encoded"]), 6)


@query(
    "a6_constant_column",
    "SELECT l_returnflag, count(*) AS n, NULL::DOUBLE AS spearman_correlation FROM lineitem GROUP BY 1",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", F.lit(7.0).alias("constant"))
    return metrics.rank_correlation(rows, "l_quantity", "constant", ["l_returnflag"])


_BY_GROUP = ("SELECT domain_id, '{0}' AS model, count(*) AS n, corr(actual, {0}_predicted) AS r, corr(ry, rp) AS s FROM ("
             "SELECT *, rank() OVER (PARTITION BY domain_id ORDER BY actual) + (count(*) OVER (PARTITION BY domain_id, actual) - 1) / 2.0::DOUBLE AS ry, "
             "rank() OVER (PARTITION BY domain_id ORDER BY {0}_predicted) + (count(*) OVER (PARTITION BY domain_id, {0}_predicted) - 1) / 2.0::DOUBLE AS rp "
             "FROM results) GROUP BY domain_id")


@query(
    "a5_a6_p_values",
    with_(RESULTS + ", grouped AS (" + " UNION ALL ".join(_BY_GROUP.format(m) for m in MODELS) + ")",
          f"SELECT domain_id, model, n, {ra('r', 'pearson_correlation', 6)}, {ra(p_value_sql('r', 'n'), 'pearson_p_value', 6)}, "
          f"{ra('s', 'spearman_correlation', 6)}, {ra(p_value_sql('s', 'n'), 'spearman_p_value', 6)} FROM grouped"),
)
def _(spark, folder):
    """Two-sided p-values per group."""
    return fix(metrics.regression_metrics(
        results(spark, folder).select("domain_id", "actual", *PREDICTIONS.values()).persist(), "actual", PREDICTIONS, by=["domain_id"],
        metrics=("pearson_correlation", "pearson_p_value", "spearman_correlation", "spearman_p_value")), 6)


_REPORT_PARTS = ["resname", "secondary_structure_encoded", "core_exterior_encoded"]


@query(
    "a14_position_report",
    with_(RESULTS + ", firsts AS (SELECT *, row_number() OVER (PARTITION BY domain_id, resid ORDER BY l_orderkey, l_partkey) AS rn FROM results)",
          f"SELECT domain_id, resid, {', '.join(_REPORT_PARTS)}, " + ", ".join(
              ra(e, n, 2) for e, n in [("actual", "actual"), *[(f"{m}_{k}", f"{m}_{k}") for m in MODELS for k in ("predicted", "error", "abs_error")],
                                       ("beta_uncertainty", "beta_uncertainty")])
          + ", " + ra("CASE WHEN beta_uncertainty > 0 THEN beta_abs_error / beta_uncertainty END", "beta_normalized_error", 2) + " FROM firsts WHERE rn = 1"),
)
def _(spark, folder):
    return fix(metrics.position_report(results(spark, folder), "actual", MODELS, ["l_orderkey", "l_partkey"]), 2)


@query(
    "a15_scaling_factors",
    with_(WIDE, " UNION ALL ".join(
        f"SELECT '{a}_to_{b}' AS pair, {ra(f'avg(CASE WHEN actual_{a} > 0 AND actual_{b} > 0 THEN actual_{b} / actual_{a} END)', 'factor', 6)} FROM wide"
        for a, b in combinations(YEARS, 2))),
)
def _(spark, folder):
    return fix(across.scaling_factors(wide(spark, folder), YEARS, "actual"), 6)


def _calibration_sql() -> str:
    e, s = "beta_abs_error", "beta_uncertainty"
    within = {k: f"avg(CAST({e} <= {k} * {s} AS INTEGER))" for k in (1, 2, 3)}
    ideal = {1: 0.68, 2: 0.95, 3: 0.997}
    gap = {k: f"abs({within[k]} - {ideal[k]}::DOUBLE)" for k in ideal}
    columns = [ra(within[k], f"within_{k}std", 6) for k in ideal] + [ra(gap[k], f"calibration_error_{k}std", 6) for k in ideal]
    columns += [
        ra(f"({gap[1]} + {gap[2]} + {gap[3]}) / 3", "avg_calibration_error", 6),
        ra(f"avg(0.5 * ln(2 * pi() * {s} * {s}) + 0.5 * {e} * {e} / ({s} * {s}))", "nlpd", 6),
        ra(f"corr({s}, {e})", "uncertainty_error_correlation", 6),
    ]
    return "SELECT shipyear, 'beta' AS model, " + ", ".join(columns) + " FROM results GROUP BY 1"


@query("a16_calibration", with_(RESULTS, _calibration_sql()))
def _(spark, folder):
    return fix(metrics.calibration(results(spark, folder), "actual", ["beta"], ["shipyear"]), 6)


_COMPOSITION_SQL = ", ".join(
    ["count(*) AS num_residues", ra("avg(core_exterior_encoded) * 100", "percent_surface", 3)]
    + [ra(f"avg(CAST(secondary_structure_encoded = {c} AS INTEGER)) * 100", f"percent_{n}", 3)
       for c, n in ((0, "helix"), (1, "sheet"), (2, "loop"))]
)


@query(
    "a17_group_performance",
    with_(RESULTS, f"SELECT domain_id, {_COMPOSITION_SQL}, " + ", ".join(
        ra(_metric_sql(m)[k][0], f"{m}_{'pearson' if 'pearson' in k else k}", 3) for m in MODELS for k in ("rmse", "mae", "r2", "pearson_correlation"))
          + " FROM results GROUP BY 1"),
)
def _(spark, folder):
    return fix(groups.group_performance(results(spark, folder), "actual", MODELS), 3)


@query(
    "a18_group_error_metrics",
    with_(RESULTS, f"SELECT domain_id, {_COMPOSITION_SQL}, " + ", ".join(
        x for m in MODELS for x in (
            *[ra(_metric_sql(m)[k][0], f"{m}_{k}", 3) for k in ("rmse", "mae", "r2")],
            ra(f"avg({m}_error)", f"{m}_mean_error", 3), ra(f"stddev_pop({m}_error)", f"{m}_std_error", 3),
            ra(f"corr({m}_predicted, esm_rmsf)", f"{m}_corr_with_esm_rmsf", 3), ra(f"corr({m}_predicted, voxel_rmsf)", f"{m}_corr_with_voxel_rmsf", 3)))
          + " FROM results GROUP BY 1"),
)
def _(spark, folder):
    return fix(groups.group_error_metrics(results(spark, folder), "actual", MODELS, ("esm_rmsf", "voxel_rmsf")), 3)


def _summary_sql(error: str, lead: str) -> str:
    return ", ".join([ra(f"avg({error})", f"{lead}mean_error", 3), ra(f"quantile_cont({error}, 0.5)", f"{lead}median_error", 3),
                      ra(f"stddev_samp({error})", f"{lead}std_error", 3)])


_ALL_SUMMARIES = ", ".join(_summary_sql(f"{m}_abs_error", f"{m}_") for m in MODELS)


def _span(column: str, source: str) -> str:
    return f"span AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source})"


def _cut_sql(column: str, bins: int) -> str:
    """Right-closed bin number, from a joined one-row ``span``."""
    return "(" + " + ".join(f"CAST({column} > lo + {i} * ((hi - lo) / {bins}) AS INTEGER)" for i in range(1, bins)) + ")"


def _histogram_sql(column: str, bins: int) -> str:
    return "(" + " + ".join(f"CAST({column} >= lo + {i} * ((hi - lo) / {bins}) AS INTEGER)" for i in range(1, bins)) + ")"


@query(
    "a19_errors_by_position",
    with_(RESULTS + ", " + _span("normalized_resid", "results"),
          f"SELECT {_cut_sql('normalized_resid', 20)} AS resid_bin, count(*) AS \"count\", {_ALL_SUMMARIES} FROM results, span GROUP BY 1"),
)
def _(spark, folder):
    return fix(groups.errors_by_position(results(spark, folder), MODELS), 3)


@query(
    "a20_errors_by_structure",
    with_(RESULTS, "SELECT CASE secondary_structure_encoded WHEN 0 THEN 'helix' WHEN 1 THEN 'sheet' ELSE 'loop' END AS secondary_structure, "
                   f"count(*) AS \"count\", {_ALL_SUMMARIES} FROM results GROUP BY 1"),
)
def _(spark, folder):
    return fix(groups.errors_by_structure(results(spark, folder), MODELS), 3)


_BY_CATEGORY_SQL = with_(RESULTS, f"SELECT resname, count(*) AS \"count\", {_ALL_SUMMARIES} FROM results GROUP BY 1")


@query("a21_errors_by_category", _BY_CATEGORY_SQL)
def _(spark, folder):
    return fix(groups.errors_by_category(results(spark, folder), MODELS), 3)


@query("a21_errors_by_hot_category", _BY_CATEGORY_SQL)
def _(spark, folder):
    """Medians beside any aggregates, by the plan for categories too large for one task, forced by a low limit."""
    columns = [F.col(f"{m}_abs_error") for m in MODELS]
    found = aggregate_with_medians(
        results(spark, folder).select("resname", *columns).persist(), ["resname"],
        [F.count(F.lit(1)).alias("count"), *[f(c).alias(f"{m}_{n}_error") for m, c in zip(MODELS, columns, strict=True) for n, f in (("mean", F.avg), ("std", F.stddev_samp))]],
        {f"{m}_median_error": c for m, c in zip(MODELS, columns, strict=True)}, max_group_rows=10)
    return fix(found, 3)


# ---- cross-condition ---------------------------------------------------------


def _correlation_sql(prefix: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS condition_a, '{b}' AS condition_b, "
        + ("max(1.0::DOUBLE) AS r" if a == b else ra(f"corr({prefix}_{a}, {prefix}_{b})", "r", 6)) + " FROM wide"
        for a in YEARS for b in YEARS
    )


for _prefix in ("actual", "alpha_pred", "beta_pred"):
    def _corr(spark, folder, prefix=_prefix):
        return fix(across.condition_correlations(wide(spark, folder), YEARS, prefix), 6)

    query(f"a22_correlations_{_prefix}", with_(WIDE, _correlation_sql(_prefix)))(_corr)


@query(
    "a22_correlation_matrix",
    with_(WIDE + ", pairs AS (" + _correlation_sql("actual") + ")",
          "SELECT condition_a AS condition, " + ", ".join(f"max(CASE WHEN condition_b = '{y}' THEN r END) AS \"{y}\"" for y in YEARS) + " FROM pairs GROUP BY 1"),
)
def _(spark, folder):
    return across.correlation_matrix(fix(across.condition_correlations(wide(spark, folder), YEARS), 6), YEARS)


_A23 = ("rmse", "r2", "pearson_correlation", "median_absolute_error")


@query(
    "a23_condition_metrics",
    with_(CELLS, _per_model(lambda m: ", ".join(ra(_metric_sql(m)[k][0], k, 3) for k in _A23), "cells", "condition")),
)
def _(spark, folder):
    rows = cells(spark, folder).select("condition", "actual", *PREDICTIONS.values()).persist()
    return fix(across.condition_metrics(rows, MODELS, _A23), 3)


def _p_sql(r2: str, n: str) -> str:
    """Closed forms of the two-sided t tail, by whole degrees of freedom."""
    theta = f"atan2(sqrt({r2}), sqrt(1 - {r2}))"
    s, c = f"sin({theta})", f"cos({theta})"
    forms = {
        1: f"1 - 2 / pi() * {theta}",
        2: f"1 - {s}",
        3: f"1 - 2 / pi() * ({theta} + {s} * {c})",
        4: f"1 - {s} * (1 + {c} * {c} / 2)",
        5: f"1 - 2 / pi() * ({theta} + {s} * ({c} + 2.0::DOUBLE / 3 * {c} * {c} * {c}))",
    }
    return f"CASE WHEN {n} = 2 OR {r2} >= 1 THEN 0 " + " ".join(f"WHEN {n} = {d + 2} THEN greatest(0, {e})" for d, e in forms.items()) + " END"


_TRENDS = CELLS + """,
fitted AS (
  SELECT domain_id, resid, resname, regr_slope(actual, t) AS slope, regr_intercept(actual, t) AS intercept,
         corr(actual, t) ** 2 AS r_squared, count(*) AS n, min(actual) AS lo, max(actual) AS hi,
         row_number() OVER (PARTITION BY domain_id, resid ORDER BY resname) AS rn
  FROM (SELECT *, CAST(condition AS DOUBLE) AS t FROM cells) GROUP BY domain_id, resid, resname),
trends AS (SELECT * FROM fitted WHERE rn = 1 AND n > 1 AND lo < hi),
limits AS (SELECT avg(slope) + 2 * stddev_pop(slope) AS high FROM trends)
"""


def _trends(spark, folder):
    return trends.position_trends(cells(spark, folder), YEARS)


@query(
    "a24_position_trends",
    with_(_TRENDS, f"SELECT {_KEYS}, {ra('slope', 'slope', 3)}, {ra('intercept', 'intercept', 1)}, {ra('r_squared', 'r_squared', 6)}, "
                   f"{ra(_p_sql('r_squared', 'n'), 'p_value', 5)} FROM trends"),
)
def _(spark, folder):
    found = _trends(spark, folder)
    digits = {"slope": 3, "intercept": 1, "r_squared": 6, "p_value": 5}
    return found.select(*CELL_KEYS, *[
        (F.floor(F.col(c) * F.lit(float(10**d)) + HALF) / F.lit(float(10**d))).alias(c) for c, d in digits.items()])


@query(
    "a25_trend_outliers",
    with_(_TRENDS, f"SELECT {_KEYS}, {ra('slope', 'slope')}, {ra('r_squared', 'r_squared')}, "
                   "CASE WHEN slope < 0 THEN 'negative_trend' ELSE 'high_increase' END AS behavior FROM trends, limits WHERE slope < 0 OR slope > high"),
)
def _(spark, folder):
    return fix(trends.trend_outliers(Kept()(_trends(spark, folder))))


_STATS_SQL = f"{ra('avg(slope)', 'avg_slope')}, {ra('stddev_pop(slope)', 'std_slope')}, {ra('avg(r_squared)', 'avg_r_squared')}, count(*) AS num_residues_analyzed"


@query(
    "a26_group_trends",
    with_(_TRENDS, f"SELECT domain_id, {_STATS_SQL}, count(*) FILTER (WHERE slope < 0 OR slope > high) AS outliers_count FROM trends, limits GROUP BY 1"),
)
def _(spark, folder):
    return fix(trends.group_trends(Kept()(_trends(spark, folder))))


@query("a27_category_trends", with_(_TRENDS, f"SELECT resname, {_STATS_SQL} FROM trends GROUP BY 1"))
def _(spark, folder):
    return fix(trends.category_trends(_trends(spark, folder)))


_GROUPED_SQL = ", ".join(
    ra(f"{fn}({m}_abs_error_{y}{arg})", f"{m}_{name}_abs_error_{y}", 3)
    for m in MODELS for y in YEARS
    for name, fn, arg in (("mean", "avg", ""), ("median", "quantile_cont", ", 0.5"), ("std", "stddev_samp", ""))
)


@query("a28_grouped_errors", with_(WIDE, f"SELECT resname, count(*) AS \"count\", {_GROUPED_SQL} FROM wide GROUP BY 1"))
def _(spark, folder):
    return fix(across.grouped_errors(wide(spark, folder), "resname", YEARS, MODELS), 3)


@query(
    "a28_structure_errors",
    with_(WIDE, "SELECT CASE secondary_structure_encoded WHEN 0 THEN 'Helix' WHEN 1 THEN 'Sheet' WHEN 2 THEN 'Loop/Other' ELSE 'Unknown' END "
                f"AS secondary_structure_encoded, count(*) AS \"count\", {_GROUPED_SQL} FROM wide GROUP BY 1"),
)
def _(spark, folder):
    return fix(across.structure_errors(wide(spark, folder), "secondary_structure_encoded", YEARS, MODELS, STRUCTURE_LABELS), 3)


@query(
    "a29_binned_errors",
    with_(WIDE + ", " + _span("relative_accessibility", "wide") + ", binned AS (SELECT *, " + _cut_sql("relative_accessibility", 10)
          + " AS b FROM wide, span WHERE relative_accessibility IS NOT NULL), edged AS (SELECT *, "
          "CASE WHEN b = 0 THEN lo - (hi - lo) * 0.001::DOUBLE ELSE lo + b * ((hi - lo) / 10) END AS bs, "
          "CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END AS be FROM binned)",
          f"SELECT 'relative_accessibility' AS feature, {ra('bs', 'bin_start', 5)}, {ra('be', 'bin_end', 5)}, {ra('(bs + be) / 2', 'bin_center', 5)}, "
          "count(*) AS \"count\", " + ", ".join(ra(f"avg({m}_abs_error_{y})", f"{m}_mean_abs_error_{y}", 3) for m in MODELS for y in YEARS)
          + " FROM edged GROUP BY bs, be"),
)
def _(spark, folder):
    binned = across.binned_errors(wide(spark, folder), "relative_accessibility", YEARS, MODELS)
    digits = {c: 5 if c.startswith("bin_") else 3 for c in binned.columns if c not in ("feature", "count")}
    return binned.select("feature", "count", *[
        (F.floor(F.col(c) * F.lit(float(10**d)) + HALF) / F.lit(float(10**d))).alias(c) for c, d in digits.items()])


def _performance_sql() -> str:
    columns = []
    for y in YEARS:
        a = f"actual_{y}"
        columns += [f"count({a}) AS num_residues_{y}", ra(f"avg({a})", f"mean_actual_{y}", 3),
                    ra(f"CASE WHEN count({a}) > 1 THEN stddev_samp({a}) ELSE 0 END", f"std_actual_{y}", 3)]
        for m in MODELS:
            p = f"{m}_pred_{y}"
            ok = f"count({a}) > 1 AND var_pop({a}) > 1e-9 AND var_pop({p}) > 1e-9"
            met = f"count({a}) > 1 AND bool_and(abs({a} - {p}) <= 1e-8 + 1e-5 * abs({p}))"
            columns += [
                ra(f"sqrt(avg(({a} - {p}) * ({a} - {p})))", f"{m}_rmse_{y}", 3),
                ra(f"CASE WHEN {ok} THEN {_r2_sql(a, p)} WHEN {met} THEN 0 END", f"{m}_r2_{y}", 3),
                ra(f"CASE WHEN {ok} THEN corr({a}, {p}) WHEN {met} THEN 1 END", f"{m}_pearson_{y}", 3),
            ]
    return "SELECT domain_id, " + ", ".join(columns) + " FROM wide GROUP BY 1"


@query("a30_group_performance_by_condition", with_(WIDE, _performance_sql()))
def _(spark, folder):
    return fix(across.group_performance_by_condition(wide(spark, folder), YEARS, MODELS), 3)


_EDGES_SQL = ra("lo + b * ((hi - lo) / 20)", "bin_start", 3) + ", " + ra("CASE WHEN b = 19 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 20) END", "bin_end", 3)


@query(
    "a31_pooled_histogram",
    with_(WIDE + ", pooled AS (" + " UNION ALL ".join(
        f"SELECT '{y}' AS condition, '{t}' AS type, {c} AS v FROM wide WHERE {c} IS NOT NULL"
        for y in YEARS for t, c in (("actual", f"actual_{y}"), ("predicted_alpha", f"alpha_pred_{y}")))
          + "), span AS (SELECT greatest(0, quantile_cont(v, 0.01)) AS lo, quantile_cont(v, 0.99) AS hi FROM pooled), "
          "placed AS (SELECT condition, type, " + _histogram_sql("v", 20) + " AS b, count(*) AS n FROM pooled, span WHERE v >= lo AND v <= hi GROUP BY ALL), "
          "grid AS (SELECT DISTINCT condition, type, b FROM pooled, (SELECT unnest(range(20)) AS b))",
          f"SELECT condition, type, {_EDGES_SQL}, COALESCE(n, 0) AS \"count\" FROM grid LEFT JOIN placed USING (condition, type, b), span"),
)
def _(spark, folder):
    return fix(across.pooled_histogram(wide(spark, folder), YEARS, "alpha"), 3)


@query(
    "a32_run_histogram",
    with_(RESULTS + ", " + _span("actual", "results") + ", pooled AS (SELECT 'actual' AS source, actual AS v FROM results UNION ALL "
          + " UNION ALL ".join(f"SELECT '{m}', {m}_predicted FROM results" for m in MODELS) + "), placed AS (SELECT source, " + _histogram_sql("v", 20)
          + " AS b, count(*) AS n FROM pooled, span WHERE v >= lo AND v <= hi GROUP BY ALL), "
          "grid AS (SELECT DISTINCT source, b FROM pooled, (SELECT unnest(range(20)) AS b))",
          f"SELECT source, {_EDGES_SQL}, COALESCE(n, 0) AS \"count\" FROM grid LEFT JOIN placed USING (source, b), span"),
)
def _(spark, folder):
    return fix(across.run_histogram(results(spark, folder), "actual", MODELS), 3)


@query(
    "a33_features_to_bin",
    with_(WIDE, " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS known, {ra(f'CAST(max({c}) AS DOUBLE)', 'highest', 3)} FROM wide"
        for c in ("domain_id", "relative_accessibility"))),
)
def _(spark, folder):
    aligned = wide(spark, folder)
    chosen = across.features_to_bin(aligned, YEARS)
    counted = aligned.agg(*[
        F.struct(F.lit(c).alias("feature"), F.count(c).alias("known"), F.max(c).cast("double").alias("highest")).alias(f"c{i}")
        for i, c in enumerate(chosen)])
    return fix(counted.select(F.inline(F.array(*[f"c{i}" for i in range(len(chosen))]))), 3)


@query("a34_r2_by_model", with_(RESULTS, _per_model(lambda m: ra(_metric_sql(m)["r2"][0], "r2", 6), "results")))
def _(spark, folder):
    return fix(metrics.r2_by_model(results(spark, folder), "actual", PREDICTIONS), 6)


_A35 = ("mae", "r2", "rmse")


@query("a35_metrics_table", with_(RESULTS, _per_model(lambda m: ", ".join(ra(_metric_sql(m)[k][0], k, 3) for k in _A35), "results")))
def _(spark, folder):
    scored = metrics.regression_metrics(results(spark, folder), "actual", PREDICTIONS, metrics=_A35)
    return fix(metrics.metrics_table(metrics.long_metrics(scored), _A35), 3)


# ---- top-k and reshaping -----------------------------------------------------


@query(
    "t1_top_importances",
    with_(RESULTS, "SELECT resname AS feature, " + ra("CAST(sum(cents) AS DOUBLE) / (SELECT sum(cents) FROM results)", "importance", 6)
          + " FROM results GROUP BY 1 ORDER BY sum(cents) DESC, 1 LIMIT 15"),
)
def _(spark, folder):
    rows = results(spark, folder).persist()
    total = rows.agg(F.sum("cents")).first()[0]
    shares = rows.groupBy(F.col("resname").alias("feature")).agg((F.sum("cents") / F.lit(total)).alias("importance"))
    return fix(reports.top_importances(shares), 6)


@query("t2_largest_group", with_(RESULTS, "SELECT domain_id, count(*) AS rows FROM results GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def _(spark, folder):
    return reports.largest_group(results(spark, folder))


_NEIGHBORHOOD_SQL = with_(
    POSITIONS + ", chosen AS (SELECT min(domain_id) AS g FROM (SELECT domain_id FROM positions GROUP BY 1 HAVING count(*) >= 50)), "
    "peak AS (SELECT resid AS anchor FROM positions, chosen WHERE domain_id = g AND rmsf_320 IS NOT NULL ORDER BY rmsf_320 DESC, resid LIMIT 1)",
    "SELECT domain_id, resid, resname, " + ra("rmsf_320", "rmsf_320") + " FROM positions, chosen, peak WHERE domain_id = g AND "
    "resid BETWEEN greatest(0, anchor - 1000) AND anchor + 1000",
)


@query("t3_extreme_neighborhood", _NEIGHBORHOOD_SQL)
def _(spark, folder):
    return fix(reports.extreme_neighborhood(positions(spark, folder), "rmsf_320", reach=1000))


@query(
    "t4_best_model",
    with_(RESULTS + ", scored AS (" + _per_model(lambda m: f"{_r2_sql('actual', f'{m}_predicted')} AS r2", "results") + ")",
          "SELECT model FROM scored ORDER BY r2 DESC LIMIT 1"),
)
def _(spark, folder):
    scored = metrics.regression_metrics(results(spark, folder), "actual", PREDICTIONS, metrics=("r2", "rmse"))
    best = reports.best_model(scored)
    return results(spark, folder).select(F.lit(best).alias("model")).distinct()


@query(
    "t5_categories_by_median_error",
    with_(RESULTS, "SELECT resname, " + ra("quantile_cont(alpha_abs_error, 0.5)", "median_error", 3) + " FROM results GROUP BY 1"),
)
def _(spark, folder):
    return fix(reports.categories_by_median_error(results(spark, folder), "alpha_abs_error"), 3)


@query(
    "t5_most_frequent_categories",
    with_(RESULTS, "SELECT resname, count(*) AS \"count\" FROM results GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
)
def _(spark, folder):
    return reports.most_frequent_categories(results(spark, folder))


@query(
    "t6_unpivot_conditions",
    with_(WIDE, " UNION ALL ".join(
        f"SELECT {_KEYS}, {ra(f'{m}_abs_error_{y}', 'abs_error', 3)}, '{y}' AS condition, '{m}_abs_error' AS metric FROM wide" for m in MODELS for y in YEARS)),
)
def _(spark, folder):
    aligned = wide(spark, folder).drop(*_DIFFS)
    return fix(reports.unpivot_conditions(aligned, CELL_KEYS, "_abs_error_", "abs_error"), 3)


_SURFACE = RESULTS + ", " + _span("normalized_resid", "results") + ", surface AS (SELECT " + _cut_sql("normalized_resid", 10) + (
    " AS position_bin, secondary_structure_encoded AS secondary_structure, avg(alpha_abs_error) AS mean_error, count(*) AS n "
    "FROM results, span GROUP BY 1, 2)")


@query(
    "t7_surface_matrix",
    with_(_SURFACE, "SELECT secondary_structure, " + ", ".join(
        ra(f"max(CASE WHEN position_bin = {i} THEN mean_error END)", str(i), 3) for i in range(10)) + " FROM surface GROUP BY 1"),
)
def _(spark, folder):
    return fix(reports.surface_matrix(reports.response_surface(results(spark, folder), "alpha")), 3)


_MEANS = " + ".join(f"COALESCE(alpha_abs_error_{y}, 0)" for y in YEARS)
_KNOWN = " + ".join(f"CAST(alpha_abs_error_{y} IS NOT NULL AS INTEGER)" for y in YEARS)


@query("t8_mean_over_conditions", with_(WIDE, f"SELECT {_KEYS}, {ra(f'({_MEANS}) / NULLIF({_KNOWN}, 0)', 'avg_error', 3)} FROM wide"))
def _(spark, folder):
    return fix(reports.mean_over_conditions(wide(spark, folder), CELL_KEYS, "alpha_abs_error_"), 3)


@query("t9_distinct_keys", with_(RESULTS, "SELECT DISTINCT domain_id, resid FROM results"))
def _(spark, folder):
    return results(spark, folder).select("domain_id", "resid").distinct()


@query(
    "t10_union_tables",
    f"SELECT c_custkey AS key, c_name AS name, {ra('c_acctbal', 'acctbal', 2)}, c_mktsegment AS segment FROM customer UNION ALL "
    f"SELECT s_suppkey, s_name, {r('s_acctbal', 2)}, NULL FROM supplier",
)
def _(spark, folder):
    buyers = table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS acctbal", "c_mktsegment AS segment")
    sellers = table(spark, folder, "supplier").selectExpr("s_name AS name", "s_suppkey AS key", "s_acctbal AS acctbal")
    return fix(union_tables([buyers, sellers]), 2)


@query(
    "t11_correlations_of_condition",
    with_(WIDE, " UNION ALL ".join(
        f"SELECT '{y}' AS condition, " + ("max(1.0::DOUBLE) AS r" if y == 1998 else ra(f"corr(actual_1998, actual_{y})", "r", 6)) + " FROM wide" for y in YEARS)),
)
def _(spark, folder):
    return fix(across.correlations_of(across.condition_correlations(wide(spark, folder), YEARS), 1998), 6)


# ---- report extracts ---------------------------------------------------------


@query(
    "r1_group_profile",
    with_(RESULTS, "SELECT domain_id, resid, resname, " + ", ".join(ra(c, c, 2) for c in ("actual", "alpha_predicted", "beta_predicted"))
          + ", secondary_structure_encoded, core_exterior_encoded FROM results WHERE domain_id = "
            "(SELECT domain_id FROM results GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
)
def _(spark, folder):
    return fix(reports.group_profile_rows(results(spark, folder), "actual", MODELS), 2)


@query("r2_category_errors", with_(RESULTS, f"SELECT resname, {ra('beta_abs_error', 'error', 2)} FROM results"))
def _(spark, folder):
    return fix(reports.category_errors(results(spark, folder), "beta"), 2)


@query("r3_category_values", with_(RESULTS, f"SELECT resname, {ra('actual', 'actual', 2)}, {ra('beta_predicted', 'predicted', 2)} FROM results"))
def _(spark, folder):
    return fix(reports.category_values(results(spark, folder), "actual", "beta"), 2)


_PARTS = {
    "secondary_structure": "CASE secondary_structure_encoded WHEN 0 THEN 'Helix' WHEN 1 THEN 'Sheet' ELSE 'Loop/Other' END",
    "surface_exposure": "CASE core_exterior_encoded WHEN 0 THEN 'Core' ELSE 'Surface' END",
    "sequence_position": f"CASE {_cut_sql('normalized_resid', 5)} WHEN 0 THEN 'N-term' WHEN 1 THEN 'N-quarter' WHEN 2 THEN 'Middle' "
                         "WHEN 3 THEN 'C-quarter' ELSE 'C-term' END",
}


@query(
    "r4_errors_by_property",
    with_(RESULTS + ", " + _span("normalized_resid", "results"), " UNION ALL ".join(
        f"SELECT '{p}' AS property, {e} AS value, count(*) AS \"count\", {_summary_sql('alpha_abs_error', '')} FROM results, span GROUP BY 2" for p, e in _PARTS.items())),
)
def _(spark, folder):
    return fix(reports.errors_by_property(results(spark, folder), "alpha"), 3)


@query("r5_model_pairs", with_(RESULTS, "SELECT " + ", ".join(ra(c, c, 2) for c in ("actual", "alpha_predicted", "beta_predicted")) + " FROM results"))
def _(spark, folder):
    return fix(reports.model_pairs(results(spark, folder), "actual", MODELS)[("alpha", "beta")], 2)


@query("r6_actual_and_predicted", with_(RESULTS, f"SELECT {ra('actual', 'actual', 2)}, {ra('alpha_predicted', 'predicted', 2)} FROM results"))
def _(spark, folder):
    return fix(reports.actual_and_predicted(results(spark, folder), "actual", "alpha"), 2)


@query(
    "r7_angles_and_values",
    with_(POSITIONS, f"SELECT {ra('sin(radians(COALESCE(phi, 0)))', 'phi', 6)}, {ra('sin(radians(COALESCE(psi, 0)))', 'psi', 6)}, "
                     f"{ra('rmsf_320', 'actual')}, {ra('esm_rmsf', 'predicted')} FROM positions"),
)
def _(spark, folder):
    from strandframe.operators.features import add_codes

    coded = add_codes(positions(spark, folder)).withColumnRenamed("esm_rmsf", "esm_predicted")
    shown = reports.angles_and_values(coded, "rmsf_320", "esm")
    return shown.select(*[
        (F.floor(F.col(c) * F.lit(float(10**d)) + HALF) / F.lit(float(10**d))).alias(c)
        for c, d in (("phi", 6), ("psi", 6), ("actual", 4), ("predicted", 4))])


@query("r8_extreme_neighborhood", with_(
    RESULTS + ", chosen AS (SELECT min(domain_id) AS g FROM (SELECT domain_id FROM results GROUP BY 1 HAVING count(*) >= 50)), "
    "peak AS (SELECT resid AS anchor FROM results, chosen WHERE domain_id = g ORDER BY actual DESC, resid LIMIT 1)",
    "SELECT domain_id, resid, resname, " + ra("actual", "actual", 2) + ", secondary_structure_encoded, " + ra("beta_predicted", "beta_predicted", 2)
    + " FROM results, chosen, peak WHERE domain_id = g AND resid BETWEEN greatest(0, anchor - 2) AND anchor + 2"))
def _(spark, folder):
    return fix(reports.extreme_neighborhood(results(spark, folder), "actual", "beta", reach=2), 2)


@query("r9_response_surface", with_(_SURFACE, f"SELECT position_bin, secondary_structure, {ra('mean_error', 'mean_error', 3)}, n AS \"count\" FROM surface"))
def _(spark, folder):
    return fix(reports.response_surface(results(spark, folder), "alpha"), 3)


@query(
    "r10_structure_report",
    with_(RESULTS, f"SELECT {_PARTS['secondary_structure']} AS secondary_structure, count(*) AS \"count\", " + ", ".join(
        ra(e, n, 3) for e, n in (("avg(actual)", "mean_actual"), ("avg(beta_predicted)", "mean_predicted"), ("avg(beta_abs_error)", "mean_error"),
                                 ("stddev_samp(beta_abs_error)", "std_error"))) + " FROM results GROUP BY 1"),
)
def _(spark, folder):
    return fix(reports.structure_report(results(spark, folder), "actual", "beta"), 3)


_SCATTER_HASH = ("CAST('0x' || substring(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) "
                 "|| '-' || CAST(l_suppkey AS VARCHAR) || '-42'), 1, 13) AS BIGINT)")


@query(
    "r11_scatter_sample",
    with_(RESULTS, f"SELECT domain_id, resid, resname, {ra('actual', 'actual', 2)}, {ra('alpha_predicted', 'alpha', 2)}, {ra('beta_predicted', 'beta', 2)}, "
                   f"secondary_structure_encoded, core_exterior_encoded, {ra('normalized_resid', 'normalized_resid', 2)} FROM results "
                   f"ORDER BY {_SCATTER_HASH}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5000"),
)
def _(spark, folder):
    return fix(reports.scatter_sample(results(spark, folder), "actual", MODELS, ROW_KEYS), 2)


@query(
    "r12_training_curve",
    with_(CELLS, "SELECT CAST(condition AS INTEGER) AS epoch, " + ", ".join(
        ra(f"sqrt(avg(({m}_predicted - actual) * ({m}_predicted - actual)))", f"{p}_loss", 3) for p, m in (("train", "alpha"), ("val", "beta")))
          + " FROM cells GROUP BY 1"),
)
def _(spark, folder):
    """The reshaping of a history; here each condition's RMSE plays the role of an epoch's loss."""
    scored = across.condition_metrics(cells(spark, folder), MODELS, ("rmse",))
    history = scored.select(
        F.col("condition").cast("int").alias("epoch"),
        F.when(F.col("model") == "alpha", "train").otherwise("val").alias("part"),
        F.lit("loss").alias("metric"), F.col("rmse").alias("value"))
    return fix(reports.training_curve(history), 3)


@query(
    "r13_condition_report",
    with_(CELLS, _per_model(lambda m: ", ".join(ra(_metric_sql(m)[k][0], k, 3) for k in ("rmse", "r2", "pearson_correlation")), "cells", "condition")),
)
def _(spark, folder):
    return fix(reports.condition_report(across.condition_metrics(cells(spark, folder), MODELS)), 3)
