"""Rank correlations of groups that one task may order."""

import random

from strandframe.operators import metrics


def test_rank_correlations_in_groups_equal_those_over_buckets(spark, monkeypatch):
    rng = random.Random(3)
    data = [(rng.choice([1, 2, None]), rng.choice([None, 1.0, 2.0, rng.random(), float("nan"), -0.0, 0.0]), rng.choice([None, rng.random(), 2.0]), rng.randint(0, 3) * 1.0) for _ in range(400)]
    data += [(7, 1.0, 2.0, 3.0), (8, None, 1.0, 1.0), (9, 1.0, 1.0, None), (9, 1.0, 2.0, None)]
    rows = spark.createDataFrame(data, "k int, y double, p double, q double")
    found = metrics.rank_correlations(rows, "y", {"p": "p", "q": "q"}, ["k"])
    assert "_bucket" not in found._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(metrics, "RANKED_GROUP_ROWS", 0)
    over_buckets = metrics.rank_correlations(rows, "y", {"p": "p", "q": "q"}, ["k"])
    assert sorted(map(str, found.collect())) == sorted(map(str, over_buckets.collect()))
