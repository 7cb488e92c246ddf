import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandframe.operators import ranking


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 4000, p=[0.8, 0.15, 0.05]), "v": np.round(rng.normal(0, 3, 4000), 1)})
    data.loc[data.index % 3 == 0, "v"] = 1.5  # one value in a third of all rows
    return data, spark.createDataFrame(data).withColumn("v", F.when(F.col("v") != -0.3, F.col("v"))).persist()


def known(data):
    return data[data.v != -0.3]


def test_value_ranks(values):
    data, df = values
    found = ranking.value_ranks(df, "v").toPandas()
    expected = known(data).v.rank(method="min") - 1
    first = dict(zip(known(data).v, expected, strict=True))
    assert found.n.sum() == len(known(data))
    assert all(first[v] == n for v, n in zip(found.value, found.n_before, strict=True))


def test_value_ranks_by_key(values):
    data, df = values
    found = ranking.value_ranks(df, "v", ["g"]).toPandas()
    rows = known(data)
    first = dict(zip(zip(rows.g, rows.v, strict=True), rows.groupby("g").v.rank(method="min") - 1, strict=True))
    assert all(first[(g, v)] == n for g, v, n in zip(found.g, found.value, found.n_before, strict=True))


@pytest.mark.parametrize("limit", [100_000, 50, 3])
def test_exact_quantiles(values, limit):
    data, df = values
    points = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    found = ranking.exact_quantiles(df, ["v"], points, limit=limit)["v"]
    assert found == pytest.approx(list(np.percentile(known(data).v, [100 * p for p in points])), abs=1e-12)


def test_exact_quantiles_of_nothing(values):
    _, df = values
    assert ranking.exact_quantiles(df.filter(F.lit(False)), ["v"], [0.5]) == {"v": [None]}


@pytest.mark.parametrize("limit", [10**9, 500, 0])
def test_medians_of_hot_groups(values, limit):
    data, df = values
    found = ranking.aggregate_with_medians(df, ["g"], [F.count("v").alias("n")], {"m": F.col("v")}, max_group_rows=limit)
    got = {r["g"]: (r["n"], r["m"]) for r in found.collect()}
    rows = known(data)
    assert got == {g: (len(d), pytest.approx(d.v.median())) for g, d in rows.groupby("g")}


def test_row_index_is_the_global_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("v"))
    indexed = ranking.row_index(df.withColumn("b", F.floor(F.col("v") / 90)), "b", ["v"], "at")
    assert indexed.filter(F.col("at") != F.col("v")).isEmpty()
