"""Rank correlations of whole tables: few passes, the pairs computed once, values of any number of rows."""

import math
import random

import pytest

from strandframe.operators import metrics, radix


def spearman(pairs):
    def ranks(values):
        return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]

    x, y = (ranks(side) for side in zip(*pairs, strict=True))
    mx, my = sum(x) / len(x), sum(y) / len(y)
    xy, xx, yy = (sum((a - ma) * (b - mb) for a, b in zip(u, v, strict=True)) for u, ma, v, mb in ((x, mx, y, my), (x, mx, x, mx), (y, my, y, my)))
    return xy / math.sqrt(xx * yy) if xx and yy else None


def test_ranks_of_frequent_and_infinite_values(spark):
    rng = random.Random(5)
    values = [None, math.nan, math.inf, math.inf, math.inf, -math.inf, 0.0, -0.0, 7.5, 7.5, 7.5, 7.5]
    data = [(rng.choice([*values, rng.random(), rng.random() * 1e9]), rng.choice([*values, rng.random()]), float(rng.randint(0, 2))) for _ in range(600)]
    found = {r.model: r for r in metrics.rank_correlations(spark.createDataFrame(data, "y double, p double, q double"), "y", {"p": "p", "q": "q"}).collect()}
    for i, model in enumerate("pq", 1):
        pairs = [(r[0], r[i]) for r in data if not any(v is None or math.isnan(v) for v in (r[0], r[i]))]
        assert found[model].n == len(pairs)
        assert found[model].spearman_correlation == pytest.approx(spearman(pairs), abs=1e-12)


def test_pairs_are_counted_once(spark):
    rows = spark.range(50).selectExpr("CAST(id AS DOUBLE) y", "CAST(id % 3 AS DOUBLE) p")
    plan = metrics.rank_correlations(rows, "y", {"p": "p"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 50") == 3  # the pairs, and small counts by bucket of either side


def test_few_values_need_few_passes(spark, monkeypatch):
    passes, counted = [], radix.Digits._counted
    monkeypatch.setattr(radix.Digits, "_counted", lambda self, entries: passes.append(1) or counted(self, entries))
    rows = spark.range(1000).selectExpr("36000 + 100.01D * (id % 25) AS v")
    assert len(radix.even_cuts(rows, ["v"], 100)[0]) == 24
    assert len(passes) <= 4
