"""Rank selection by digits: keys that sort like their values, exact ranks and even cuts at any depth."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.operators import radix, ranking

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), math.nextafter(8.0, 0), 8.0, math.nextafter(8.0, 9), 2.0**1023, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1e-310, 0.1, 1 / 3, math.pi, 1e22, 123456789.125]


def test_keys_of_doubles_are_their_bits(spark):
    rng = np.random.default_rng(1)
    values = ODD + [x for x in rng.integers(0, 1 << 63, 3000, dtype="i8").view("f8").tolist() if not math.isnan(x)] + rng.normal(0, 1e3, 500).tolist()
    values += [math.nextafter(2.0**e, s) for e in range(-1021, 1023, 13) for s in (0, math.inf)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = frame.select("v", radix.sort_key(F.col("v"), T.DoubleType()).alias("k")).collect()
    assert len(found) == len(values)
    for v, k in found:
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (-bits if v < 0 else bits)
        assert radix.value_of(k, T.DoubleType()) == v
    missing = spark.createDataFrame([(None,), (math.nan,)], "v double").select(radix.sort_key(F.col("v"), T.DoubleType()).alias("k"))
    assert [r.k for r in missing.collect()] == [None, None]


@settings(max_examples=200, deadline=None)
@given(st.integers(-(0x7FF << 52), 0x7FF << 52), st.integers(-(0x7FF << 52), 0x7FF << 52))
def test_values_sort_like_their_keys(a, b):
    x, y = radix.value_of(a, T.DoubleType()), radix.value_of(b, T.DoubleType())
    assert (a < b) == (x < y)


@pytest.mark.parametrize("limit", [50_000, 40, 1, 0])
def test_ranks_at_every_depth(spark, limit):
    rng = np.random.default_rng(2)
    one = np.concatenate([rng.normal(0, 3, 700), np.full(400, 1.5), [math.inf, -math.inf, -0.0, 0.0], 1 + np.arange(50) * 2.0**-52])
    two = rng.integers(-(1 << 62), 1 << 62, len(one))
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(one, two, strict=True)], "a double, b long")
    wanted = [0, 1, 350, 351, 600, 601, 1000, 1100, 1152, len(one) - 1]
    rows, found = radix.select_ranks(radix.Digits(frame, ["a", "b"]), lambda i, n: wanted, limit)
    assert rows == [len(one)] * 2
    for column, values in zip(found, (one, two), strict=True):
        ordered = sorted(values.tolist())
        assert column == {r: (ordered[r], int((values < ordered[r]).sum())) for r in wanted}


def test_cuts_are_even_where_values_are_close(spark):
    # all values lie between 1 and 1 + 1e-9, far below the first digit
    frame = spark.range(2000).select((1 + F.col("id") * 1e-12).alias("a"), F.lit(3.0).alias("b"), F.when(F.col("id") < 5, F.col("id")).alias("c"))
    a, b, c = radix.even_cuts(frame, ["a", "b", "c"], 10)
    sizes = np.diff([0, *np.searchsorted(1 + np.arange(2000) * 1e-12, a), 2000])
    assert len(sizes) <= 20 and sizes.max() <= 400
    assert b == [] and len(c) <= 10
    assert radix.even_cuts(frame.filter("id IS NULL") if "id" in frame.columns else frame.limit(0), ["a"], 10) == [[]]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_quantiles_of_text_whole_numbers_and_missing(spark, limit):
    frame = spark.createDataFrame([("3", 5, None), ("bad", 7, None), ("1.5", None, None), (None, 1, None)], "t string, n int, e double")
    found = ranking.exact_quantiles(frame, ["t", "n", "e"], [0.0, 0.5, 1.0], limit=limit)
    assert found == {"t": [1.5, 2.25, 3.0], "n": [1.0, 5.0, 7.0], "e": [None, None, None]}
