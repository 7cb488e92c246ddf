import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandframe.operators import conditions as across
from strandframe.operators import groups, metrics, reports, trends
from strandframe.plans.comparison import align, comparison_tables
from strandframe.plans.evaluation import evaluation_tables


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 400
    y = np.round(rng.gamma(2, 1, n), 2)
    data = pd.DataFrame(
        {
            "domain_id": rng.choice(["p", "q", "r"], n), "resid": np.arange(n), "resname": rng.choice(["GLY", "ALA"], n),
            "y": y, "m_predicted": np.round(y + rng.normal(0, 0.3, n), 2), "m_uncertainty": rng.uniform(0.1, 0.6, n),
            "o_predicted": np.round(rng.gamma(2, 1, n), 1), "secondary_structure_encoded": rng.integers(0, 3, n),
            "core_exterior_encoded": rng.integers(0, 2, n), "normalized_resid": np.arange(n) / n,
        }
    )
    df = metrics.add_errors(spark.createDataFrame(data), ["m", "o"], "y").persist()
    return data, df


def test_metrics(scored):
    data, df = scored
    found = metrics.regression_metrics(df, "y", {"m": "m_predicted", "o": "o_predicted"}, metrics=metrics.ALL_METRICS,
                                       n_features=3, condition=320).toPandas().set_index("model")
    for m in ("m", "o"):
        y, p = data.y, data[f"{m}_predicted"]
        e = y - p
        r2 = 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()
        expected = {
            "rmse": np.sqrt((e**2).mean()), "mae": e.abs().mean(), "r2": r2, "pearson_correlation": np.corrcoef(y, p)[0, 1],
            "explained_variance": 1 - e.var(ddof=0) / y.var(ddof=0), "max_error": e.abs().max(),
            "median_absolute_error": e.abs().median(), "adjusted_r2": 1 - (1 - r2) * (len(y) - 1) / (len(y) - 4),
            "spearman_correlation": np.corrcoef(y.rank(), p.rank())[0, 1],
            "temperature_coefficient": np.corrcoef(p, y * 320 / 400)[0, 1],
            "root_mean_square_absolute_error": np.sqrt((e**2).mean()),
        }
        for name, value in expected.items():
            assert found.loc[m, name] == pytest.approx(value, abs=1e-10), name
    assert found.loc["m", "pearson_p_value"] < 1e-50 < found.loc["o", "pearson_p_value"] <= 1


def test_metrics_of_tiny_and_flat_groups(spark):
    df = spark.createDataFrame(
        [("one", 1.0, 2.0), ("flat", 2.0, 2.0), ("flat", 2.0, 3.0), ("met", 4.0, 4.0), ("met", 4.0, 4.0)], "g string, y double, p double"
    )
    found = metrics.regression_metrics(df, "y", {"m": "p"}, by=["g"], metrics=("rmse", "r2", "pearson_correlation"))
    got = {r["g"]: (r["rmse"], r["r2"], r["pearson_correlation"]) for r in found.collect()}
    assert got["one"] == (1.0, None, None)
    assert got["flat"] == (pytest.approx(np.sqrt(0.5)), 0.0, None)
    assert got["met"] == (0.0, 1.0, None)


def test_metric_table_round_trip(scored):
    _, df = scored
    wide = metrics.regression_metrics(df, "y", {"m": "m_predicted", "o": "o_predicted"}, metrics=("rmse", "r2"))
    back = metrics.metrics_table(metrics.long_metrics(wide), ["rmse", "r2"])
    assert back.exceptAll(wide.select("model", "rmse", "r2")).isEmpty()


def test_calibration(scored):
    data, df = scored
    found = metrics.calibration(df, "y", ["m"]).first()
    e, s = (data.y - data.m_predicted).abs(), data.m_uncertainty
    within = [(e <= k * s).mean() for k in (1, 2, 3)]
    assert [found[f"within_{k}std"] for k in (1, 2, 3)] == pytest.approx(within)
    assert within == sorted(within)
    assert found["avg_calibration_error"] == pytest.approx(np.mean([abs(a - b) for a, b in zip(within, (0.68, 0.95, 0.997), strict=True)]))
    assert found["nlpd"] == pytest.approx((0.5 * np.log(2 * np.pi * s**2) + 0.5 * e**2 / s**2).mean())
    assert found["uncertainty_error_correlation"] == pytest.approx(np.corrcoef(s, e)[0, 1])
    zero = df.withColumn("m_uncertainty", F.when(F.col("resid") == 0, 0.0).otherwise(F.col("m_uncertainty")))
    assert metrics.calibration(zero, "y", ["m"]).first()["nlpd"] is None


def test_group_performance_composition(scored):
    data, df = scored
    found = groups.group_performance(df, "y", ["m"]).toPandas().set_index("domain_id")
    for g, d in data.groupby("domain_id"):
        assert found.loc[g, "num_residues"] == len(d)
        assert found.loc[g, ["percent_helix", "percent_sheet", "percent_loop"]].sum() == pytest.approx(100)
        assert found.loc[g, "m_pearson"] == pytest.approx(np.corrcoef(d.y, d.m_predicted)[0, 1])


def test_evaluation_tables(scored):
    _, df = scored
    tables = evaluation_tables(df, "y", ["m", "o"], ["domain_id", "resid"])
    results = {name: build() for name, build in tables.items()}
    assert results["rmsf_distribution"].filter("source = 'actual'").agg(F.sum("count")).first()[0] == 400
    assert results["residue_position_errors"].count() == 20
    assert results["rmsf_scatter_data"].count() == 400
    assert {r["secondary_structure"] for r in results["secondary_structure_errors"].collect()} == {"helix", "sheet", "loop"}


CONDITIONS = [320, 348, "average"]


@pytest.fixture(scope="module")
def long(spark):
    rows = [
        ("a", 1, "GLY", "320", 0.1, 1.0, 1.5), ("a", 1, "GLY", "348", 0.9, 2.0, 1.0), ("a", 1, "GLY", "average", 0.9, 1.5, 1.5),
        ("a", 2, "ALA", "320", 0.2, 3.0, 2.0), ("a", 2, "ALA", "348", 0.8, 2.0, 2.0),
        ("b", 1, "PRO", "348", 0.7, 5.0, 4.0), (None, 7, "PRO", "320", 0.3, 1.0, 1.0), (None, 7, "PRO", "348", 0.3, 4.0, 1.0),
        ("b", 3, "PRO", "320", 0.4, 2.0, 2.5), ("b", 3, "PRO", "348", 0.4, 2.0, 2.5),
    ]
    return spark.createDataFrame(
        rows, "domain_id string, resid int, resname string, condition string, relative_accessibility double, actual double, m_predicted double"
    ).withColumn("o_predicted", F.col("m_predicted") / 2)


def test_alignment_is_a_full_outer_join(long):
    grouped = across.align_conditions(long, CONDITIONS, ["m", "o"])
    joined = across.align_conditions(long, CONDITIONS, ["m", "o"], unique_keys=False)
    assert grouped.count() == 5
    assert grouped.exceptAll(joined.select(grouped.columns)).isEmpty()
    rows = {(r["domain_id"], r["resid"]): r for r in grouped.collect()}
    assert rows[("b", 1)]["actual_320"] is None and rows[("b", 1)]["relative_accessibility"] is None
    assert rows[("a", 1)]["relative_accessibility"] == 0.1
    assert rows[(None, 7)]["actual_348"] == 4.0
    assert rows[("a", 1)]["pred_diff_320"] == 0.75


def test_repeated_keys_pair_up_like_a_join(long):
    repeated = long.unionByName(long.filter("resid = 1 AND condition = '320'"))
    assert align(repeated, CONDITIONS, ["m", "o"]).filter("domain_id = 'a' AND resid = 1").count() == 2
    assert align(long, CONDITIONS, ["m", "o"]).count() == 5


def test_correlations(long):
    wide = across.align_conditions(long, CONDITIONS, ["m", "o"])
    found = {(r["condition_a"], r["condition_b"]): r["r"] for r in across.condition_correlations(wide, [*CONDITIONS, 999]).collect()}
    a, b = [1.0, 3.0, 1.0, 2.0], [2.0, 2.0, 4.0, 2.0]
    assert found[("320", "348")] == found[("348", "320")] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert found[("320", "320")] == 1.0
    assert found[("320", "average")] is None  # a single pair
    assert found[("999", "999")] is None and found[("999", "320")] is None
    single = across.condition_correlations(wide.select("actual_320"), [320, 348]).collect()
    assert {r["r"] for r in single} == {None}


def test_trends(long):
    found = {(r["domain_id"], r["resid"]): r for r in trends.position_trends(long, CONDITIONS).collect()}
    # b/3 is constant, b/1 has one point, a null group is no group
    assert set(found) == {("a", 1), ("a", 2)}
    assert found[("a", 1)]["slope"] == pytest.approx(1 / 28)
    assert found[("a", 1)]["p_value"] == 0.0
    outliers = trends.trend_outliers(trends.position_trends(long, CONDITIONS)).collect()
    assert [(r["resid"], r["behavior"]) for r in outliers] == [(2, "negative_trend")]
    stats = trends.group_trends(trends.position_trends(long, CONDITIONS)).first()
    assert (stats["num_residues_analyzed"], stats["outliers_count"]) == (2, 1)
    assert stats["std_slope"] == pytest.approx(1 / 28)


def test_trend_uses_the_smallest_category(spark):
    rows = [("g", 1, c, str(t), y) for c, ys in (("B", (9, 1)), ("A", (1, 2))) for t, y in zip((300, 310), map(float, ys), strict=True)]
    df = spark.createDataFrame(rows, "domain_id string, resid int, resname string, condition string, actual double")
    (row,) = trends.position_trends(df, [300, 310]).collect()
    assert (row["resname"], row["slope"]) == ("A", pytest.approx(0.1))


def test_trend_matches_least_squares(spark):
    t, y = [300, 320, 350, 400, 450], [1.0, 1.3, 1.1, 2.0, 2.2]
    df = spark.createDataFrame([("g", 1, "A", str(a), b) for a, b in zip(t, y, strict=True)], "domain_id string, resid int, resname string, condition string, actual double")
    (row,) = trends.position_trends(df, t).collect()
    slope, base = np.polyfit(t, y, 1)
    assert (row["slope"], row["intercept"]) == (pytest.approx(slope), pytest.approx(base))
    assert row["r_squared"] == pytest.approx(np.corrcoef(t, y)[0, 1] ** 2)


def test_grouped_errors_keep_a_null_group(long):
    wide = across.align_conditions(long, CONDITIONS, ["m", "o"])
    found = {r["domain_id"]: r for r in across.grouped_errors(wide, "domain_id", [320, 348], ["m"]).collect()}
    assert set(found) == {"a", "b", "nan"}
    assert found["a"]["count"] == 2 and found["a"]["m_mean_abs_error_320"] == 0.75
    assert found["nan"]["m_std_abs_error_348"] is None


def test_binned_errors(long):
    wide = across.align_conditions(long, CONDITIONS, ["m", "o"])
    found = across.binned_errors(wide, "relative_accessibility", [320], ["m"], bins=3).orderBy("bin_start").collect()
    assert [r["count"] for r in found] == [2, 1, 1]
    assert found[0]["bin_start"] == pytest.approx(0.1 - 0.3e-3)
    flat = wide.withColumn("relative_accessibility", F.lit(1.0))
    assert across.binned_errors(flat, "relative_accessibility", [320], ["m"]).count() == 0
    assert across.features_to_bin(wide, CONDITIONS) == ["relative_accessibility"]


def test_guarded_group_performance(long):
    wide = across.align_conditions(long, CONDITIONS, ["m", "o"])
    found = {r["domain_id"]: r for r in across.group_performance_by_condition(wide, [320, 348], ["m"]).collect()}
    assert set(found) == {"a", "b"}
    one = found["b"]  # one value at 320
    assert (one["num_residues_320"], one["std_actual_320"], one["m_rmse_320"], one["m_r2_320"]) == (1, 0.0, 0.5, None)


def test_pooled_histogram_counts(long):
    wide = across.align_conditions(long, CONDITIONS, ["m", "o"])
    found = across.pooled_histogram(wide, [320, 348], "m", bins=4)
    assert found.count() == 16
    values = [r[0] for r in long.filter("condition in ('320', '348')").select(F.explode(F.array("actual", "m_predicted"))).collect()]
    low, high = max(0, np.percentile(values, 1)), np.percentile(values, 99)
    inside = [v for v in values if low <= v <= high]
    assert found.agg(F.sum("count")).first()[0] == len(inside)


def test_scaling_factors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 6.0), (0.0, 5.0), (None, 1.0)], "rmsf_320 double, rmsf_450 double")
    assert across.scaling_factors(df, ["450", 320, "average"]).collect() == [("320_to_450", 2.5)]


def test_comparison_tables(long):
    wide = across.align_conditions(long, CONDITIONS, ["m", "o"])
    tables = comparison_tables(long, wide, CONDITIONS, ["m", "o"])
    assert {"histogram_data", "domain_stats", "error_by_relative_accessibility_bins"} <= set(tables)
    for build in tables.values():
        build().count()


def test_reports(scored):
    data, df = scored
    assert reports.best_model(metrics.regression_metrics(df, "y", {"m": "m_predicted", "o": "o_predicted"}, metrics=("r2",))) == "m"
    near = reports.extreme_neighborhood(df, "y", "m", reach=10).collect()
    first = data[data.domain_id == "p"]
    anchor = first.loc[first.y.idxmax(), "resid"]
    assert [r["resid"] for r in near] == sorted(first[(first.resid >= max(0, anchor - 10)) & (first.resid <= anchor + 10)].resid)
    assert reports.extreme_neighborhood(df, "y", minimum=1000).count() == 0
    parts = reports.errors_by_property(df, "m").groupBy("property").agg(F.sum("count").alias("n")).collect()
    assert {r["n"] for r in parts} == {400}
    frequent = reports.most_frequent_categories(df, 1).first()
    assert frequent["resname"] == data.resname.value_counts().idxmax()
    assert reports.largest_group(df).first()["rows"] == data.domain_id.value_counts().max()


def test_repeated_keys_of_all_lines_are_paired(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag"]
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy(*keys, "l_linestatus").count()
    found = entry.queries()["j1_repeated_keys_all"](spark, folder)
    assert lines.filter("count > 1").count() > 0
    assert found.select("domain_id", "resid", "resname").distinct().count() == lines.select(*keys).distinct().count()
