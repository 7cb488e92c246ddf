"""Group statistics against pandas: hot groups, ties, missing values, extreme values, null and clashing keys."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandframe.operators import statistics


def test_equal_to_pandas_for_hot_groups_and_ties(spark):
    rng = np.random.default_rng(5)
    n = 6000
    data = pd.DataFrame({"k": rng.choice(["a", "b", "c", None], n, p=[0.6, 0.2, 0.15, 0.05]), "z": rng.integers(0, 2, n), "x": np.round(rng.normal(0, 5, n), 1), "y": rng.normal(1e6, 1e-3, n)})
    data.loc[data.index % 3 == 0, "x"] = 1.5
    data.loc[rng.random(n) < 0.1, "y"] = None
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None), "k string, z long, x double, y double")
    found = {(r.k, r.z): r for r in statistics.group_statistics(frame, ["k", "z"], {"x": "x", "y": F.col("y"), "none": F.lit(None).cast("double")}).collect()}
    expected = data.groupby(["k", "z"], dropna=False)
    assert len(found) == len(expected) == 8
    for (k, z), rows in expected:
        r = found[None if not isinstance(k, str) else k, z]
        assert r["count"] == len(rows) and r.none_mean is None and r.none_std is None and r.none_median is None
        for c in ("x", "y"):
            assert (r[f"{c}_mean"], r[f"{c}_median"]) == pytest.approx((rows[c].mean(), rows[c].median()), rel=1e-12, abs=1e-12)
            assert r[f"{c}_std"] == pytest.approx(rows[c].std(), rel=1e-9 if c == "x" else 1e-5)  # a billionth of the mean


@pytest.mark.parametrize("values, median", [
    ([], None), ([None, math.nan], None), ([3.0], 3.0), ([1.0, 2.0], 1.5), ([-0.0, 0.0, 0.0], 0.0), ([1, 2, 2, 2, 9], 2.0),
    ([1.0, math.nextafter(1.0, 2), 2.0], math.nextafter(1.0, 2)), ([-1e300, -5e-324, 5e-324, 1e300], 0.0), ([-7.5, -7.25, -1e-9, 4096.0], (-7.25 - 1e-9) / 2),
    ([0.1] * 7 + [0.2] * 7, 0.5 * (0.1 + 0.2)),
])
def test_medians_of_small_groups(spark, values, median):
    frame = spark.createDataFrame([("g", None if v is None else float(v)) for v in values], "k string, v double")
    found = statistics.group_statistics(frame, ["k"], {"v": "v"}).collect()
    if not values:
        assert found == []
        return
    known = [v for v in values if v is not None and v == v]
    assert (found[0]["count"], found[0].v_median) == (len(values), median)
    assert (found[0].v_std is None) == (len(known) < 2)


def test_the_input_is_read_once(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y")).write.parquet(str(tmp_path / "t"))
    found = statistics.group_statistics(spark.read.parquet(str(tmp_path / "t")), ["k"], {"x": "x", "y": "y"})
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1 and final.count("Scan parquet") == 1
