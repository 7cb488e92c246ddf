"""Medians of groups too large for one task."""

import math
import random

from pyspark.sql import functions as F

from strandframe.operators.radix import key_value, sort_key
from strandframe.operators.ranking import aggregate_with_medians


def test_key_value_undoes_sort_key(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.1, -1e-300, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, math.inf, -math.inf, 3.14159, 1e15 + 0.125]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for v, back in rows.select("v", key_value(sort_key(F.col("v"), rows.schema["v"].dataType))).collect():
        assert v == back


def test_medians_of_large_groups_move_counts_only(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(1e6, 1), -3.5, None, 0.0, float("nan")]), rng.choice([rng.random(), None])) for _ in range(900)]
    data += [("c", None, 1.0)] * 20 + [("d", 5.0, -2.0)]
    rows = spark.createDataFrame(data, "k string, x double, y double")
    medians = {"mx": F.col("x"), "my": F.col("y")}
    found = aggregate_with_medians(rows, ["k"], [F.count("*").alias("n")], medians, max_group_rows=10)
    built_in = aggregate_with_medians(rows, ["k"], [F.count("*").alias("n")], medians, max_group_rows=10_000)
    assert sorted(map(str, found.collect())) == sorted(map(str, built_in.collect()))
    # no window or exchange over the values of a group
    assert "Bucketizer" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "value" not in found._jdf.queryExecution().optimizedPlan().toString().split()
