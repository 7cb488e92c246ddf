import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandframe.functions import bins, codes, numeric
from strandframe.functions.significance import correlation_p_value, slope_p_value


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_codes_cover_unknown_and_null(spark):
    df = spark.createDataFrame(
        [(0, "HIS", "H", "CORE"), (1, "PRO", "-", "surface"), (2, "ZZZ", "?", None), (3, None, None, "interior")],
        "i int, resname string, dssp string, side string",
    ).select(
        "i", codes.residue_code(F.col("resname")).alias("r"), codes.structure_code(F.col("dssp")).alias("s"),
        codes.surface_code(F.col("side")).alias("c"),
        codes.surface_code(F.col("side"), ("core", "interior")).alias("wide"),
    )
    assert column(df, "r") == [12, 23, 0, 0]
    assert column(df, "s") == [0, 2, 2, 2]
    assert column(df, "c") == [0, 1, 1, 1]
    assert column(df, "wide") == [0, 1, 1, 0]


def test_number_or_null(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "x"), (2, "NaN"), (3, None)], "i int, v string")
    assert column(df.select("i", numeric.to_number("v").alias("v")), "v") == [1.5, None, None, None]


def test_bond_stability(spark):
    df = spark.createDataFrame([(0, "H", "SER"), (1, "G", "PRO"), (2, None, "ALA")], "i int, s string, r string")
    found = column(df.select("i", codes.bond_stability(F.col("s"), F.col("r")).alias("b")), "b")
    assert found == pytest.approx([1.0, 0.56, 0.1])


def test_cut_matches_pandas(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.linspace(0, 1, 41), rng.random(300)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values}))
    for n in (5, 10, 20):
        expected, edges = pd.cut(values, bins=n, labels=False, retbins=True)
        ours = bins.cut_edges(*bins.value_range(df, "v"), n)
        assert ours == pytest.approx(list(edges), abs=1e-15)
        assert column(df.select("i", bins.cut_bin(F.col("v"), ours).alias("b")), "b") == list(expected)


def test_histogram_matches_numpy(spark):
    values = np.concatenate([np.linspace(-3, 7, 61), np.random.default_rng(2).normal(0, 2, 200)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values}))
    edges = bins.histogram_edges(*bins.value_range(df, "v"), 20)
    counts = {r["b"]: r["count"] for r in df.groupBy(bins.histogram_bin(F.col("v"), edges).alias("b")).count().collect()}
    assert [counts.get(i, 0) for i in range(20)] == list(np.histogram(values, bins=20)[0])


def test_flat_ranges():
    assert bins.cut_edges(2.0, 2.0, 4) == pytest.approx([1.998, 1.999, 2.0, 2.001, 2.002])
    assert bins.histogram_edges(2.0, 2.0, 2) == [1.5, 2.0, 2.5]


def _t_tail(t: float, dof: int) -> float:
    """Two-sided tail by numeric integration of the t density."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    x = np.linspace(0, t, 200_001)
    return 1 - 2 * np.trapezoid(c * (1 + x * x / dof) ** (-(dof + 1) / 2), x)


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 5, 6, 7])
def test_slope_p_value(spark, dof):
    r2 = 0.37
    t = math.sqrt(r2 * dof / (1 - r2))
    row = spark.range(1).select(slope_p_value(F.lit(r2), F.lit(dof + 2), 9).alias("p")).first()
    assert row["p"] == pytest.approx(_t_tail(t, dof), abs=1e-9)


def test_slope_p_value_without_freedom(spark):
    row = spark.range(1).select(slope_p_value(F.lit(1.0), F.lit(2), 5).alias("p"), slope_p_value(F.lit(1.0), F.lit(4), 5).alias("q")).first()
    assert (row["p"], row["q"]) == (0.0, 0.0)


def _series_tail(r: float, dof: int) -> float:
    """The same for a whole number of degrees of freedom, by its finite trigonometric series."""
    sine, cosine = abs(r), math.sqrt(1 - r * r)
    if dof % 2 == 0:
        terms = [math.exp(math.lgamma(k + 0.5) - math.lgamma(0.5) - math.lgamma(k + 1)) * cosine ** (2 * k) for k in range(dof // 2)]
        return 1 - sine * math.fsum(terms)
    terms = [math.exp(math.lgamma(k + 1) + math.lgamma(1.5) - math.lgamma(k + 1.5)) * cosine ** (2 * k + 1) for k in range((dof - 1) // 2)]
    return 1 - 2 / math.pi * (math.asin(sine) + sine * math.fsum(terms))


def test_correlation_p_value(spark):
    cases = [(r, n) for n in (3, 4, 5, 8, 10, 33, 200, 1001, 20_000) for r in (0.001, 0.02, -0.05, 0.1, 0.3, -0.8, 0.97)]
    rows = spark.createDataFrame(cases, "r double, n long").select("r", "n", correlation_p_value("r", F.col("n")).alias("p")).collect()
    for r, n, p in rows:
        assert p == pytest.approx(_series_tail(r, n - 2), abs=1e-10)
    assert abs(_series_tail(0.3, 8) - _t_tail(0.3 * math.sqrt(8 / 0.91), 8)) < 1e-8


def test_correlation_p_value_far_out_and_at_the_ends(spark):
    cases = [(0.9, 2), (1.0, 9), (-1.0, 9), (0.0, 9), (None, 9), (math.nan, 9), (0.5, 1), (0.5, None), (1e-6, 10**13), (0.9, 10**9)]
    found = [row.p for row in spark.createDataFrame(cases, "r double, n long").select(correlation_p_value("r", "n").alias("p")).collect()]
    # at 10^13 pairs t is normal: 1e-6 lies 3.16 deviations out
    assert found[:8] == [1.0, 0.0, 0.0, 1.0, None, None, None, None]
    assert found[8] == pytest.approx(math.erfc(math.sqrt(10) / math.sqrt(2)), rel=1e-3) and found[9] == 0.0
    small = spark.createDataFrame([(0.6, 100)], "r double, n long").select(correlation_p_value("r", "n").alias("p")).first().p
    x = np.linspace(0.6, 1, 400_001)  # the density of r itself
    density = math.exp(math.lgamma(49.5) - math.lgamma(49)) / math.sqrt(math.pi) * (1 - x * x) ** 48
    assert small == pytest.approx(2 * np.trapezoid(density, x), rel=1e-6) and small < 1e-9  # far below what 1 - tail could tell


def test_pearson_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(numeric.pearson(F.col("a"), F.col("b"))).first()[0] is None
