"""Exact ranks, quantiles and row numbers without putting a group into one task.

Rows are spread over order-preserving buckets of their group. Each bucket is ranked
by itself and shifted by the size of the buckets before it, so a group holding any
share of the table is still worked on by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import to_number
from .radix import DIGIT, Digits, even_cuts, key_value, select_ranks, sort_key
from .skew import BROADCAST_KEYS, count_hot_groups, hot_keys, match_keys

_BUCKET = "__bucket"

# Values of one group that the built-in medians of one aggregate may buffer together.
MEDIAN_BUFFER_ROWS = 1_000_000


def default_buckets(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, 4 * partitions)


def with_bucket(df: DataFrame, column: str, bounds: Sequence[float], name: str = _BUCKET) -> DataFrame:
    """Add the bucket of a numeric column: a fixed function of the value alone, in sort order.

    Null has the first bucket to itself and NaN the last, as they sort.
    """
    splits = [-math.inf, *bounds, math.inf]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    bucketizer = Bucketizer(splits=splits, inputCol=column, outputCol="__raw_bucket", handleInvalid="keep")
    placed = bucketizer.transform(df)
    return placed.withColumn(name, F.coalesce(F.col("__raw_bucket").cast("int"), F.lit(-1))).drop("__raw_bucket")


def sort_number(df: DataFrame, column: str) -> Column:
    """A double that sorts like the column; different values may share one."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        # the first six bytes as a whole number, in the order of the bytes
        return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    return value.cast("double")


def _bucket_starts(df: DataFrame, keys: Sequence[str], bucket: str, weight: Column) -> DataFrame:
    """Total weight of the earlier buckets of the same key; one row per key and bucket."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, bucket, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start")
    )


def row_index(
    df: DataFrame, bucket: str, order: Sequence[str | Column], name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """0-based row number in ``order`` within ``keys``.

    ``bucket`` names a column that follows the same order, so buckets can be
    numbered apart from each other.
    """
    starts = _bucket_starts(df, keys, bucket, F.lit(1))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    numbered = df.withColumn("__inside", F.row_number().over(inside) - 1)
    joined = match_keys(numbered, starts, [*keys, bucket], "inner", known=[bucket])
    return joined.withColumn(name, (F.col("__inside") + F.col("__start")).cast("long")).drop(
        "__inside", "__start"
    )


def value_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), bounds: Sequence[float] | None = None
) -> DataFrame:
    """Every distinct value with its row count ``n`` and ``n_before`` smaller rows.

    Equal values are counted before anything is ordered, so a value repeated in a third
    of all rows is still one row here.
    """
    data = df.select(*keys, to_number(value).alias("value")).filter(F.col("value").isNotNull())
    if bounds is None:
        (bounds,) = even_cuts(data, ["value"], default_buckets(df))
    counted = (
        with_bucket(data, "value", bounds)
        .groupBy(*keys, _BUCKET, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rank_counts(counted, _BUCKET, "value", keys).select(*keys, "value", "n", "n_before")


def rank_counts(counted: DataFrame, bucket: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counted values (keys, bucket, value, ``n``) with ``n_before``, the rows of smaller values of their keys."""
    starts = _bucket_starts(counted, keys, bucket, F.col("n"))
    smaller = Window.partitionBy(*keys, bucket).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.withColumn("__inside", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    placed = match_keys(inside, starts, [*keys, bucket], "inner", known=[bucket])
    return placed.select(*keys, bucket, value, "n", (F.col("__inside") + F.col("__start")).alias("n_before"))


def _interpolate(low: float, high: float, share: float) -> float:
    step = high - low
    return high - step * (1 - share) if share >= 0.5 else low + step * share


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = 50_000
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of whole columns.

    Ranks are found digit by digit for all columns at once; intervals of at most ``limit`` rows are
    read as counted values. Nothing is ordered in one task, and what reaches the driver is bounded.
    """
    numbers = df.select(*[to_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = _quantiles(Digits(numbers, numbers.columns), probabilities, limit)
    return dict(zip(columns, found, strict=True))


def pooled_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = 50_000
) -> list[float | None]:
    """The same of the values of several columns taken together."""
    numbers = df.select(*[to_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return _quantiles(Digits(numbers, [numbers.columns]), probabilities, limit)[0]


def _quantiles(digits: Digits, probabilities: Sequence[float], limit: int) -> list[list[float | None]]:
    def ranks(_, n: int) -> set[int]:
        return {f((n - 1) * p) for p in probabilities for f in (math.floor, math.ceil)}

    rows, found = select_ranks(digits, ranks, limit)
    return [
        [_interpolate(at[math.floor(r)][0], at[math.ceil(r)][0], r - math.floor(r)) if n else None for r in ((n - 1) * p for p in probabilities)]
        for n, at in zip(rows, found, strict=True)
    ]


def _medians_by_digits(values: DataFrame, keys: Sequence[str], names: Sequence[str], few: bool) -> DataFrame:
    """(keys, median of each double column of ``names``) of groups of any size.

    As in ``Digits``, for all groups and columns at once: rows are counted by the next digit of their sort key,
    combined before the shuffle, and the digit that holds a wanted rank is followed. What is shuffled are counts, at
    most 2^DIGIT a group and column; no group's values meet in one task. ``few``: the groups may be broadcast.
    """
    entries = [F.struct(F.lit(j).alias("__j"), sort_key(F.col(f"`{n}`"), T.DoubleType()).alias("__key")) for j, n in enumerate(names)]
    rows = values.select(*keys, F.inline(F.array(*entries))).filter(F.col("__key").isNotNull())
    parts = [*keys, "__j"]
    digit = F.shiftright("__key", 64 - DIGIT)
    counted = rows.groupBy(*parts, digit.alias("__prefix")).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*parts))
    counted = counted.withColumn("__ranks", F.array(*[((total - 1 + up) / 2).cast("long") for up in (0, 1)]))
    counted = counted.select(*parts, "__prefix", "__n", F.posexplode("__ranks").alias("__r", "__rank"))
    for bits in range(DIGIT, 65, DIGIT):
        within = Window.partitionBy(*parts, "__r").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("__n").over(within), F.lit(0))
        at = counted.withColumn("__before", before).filter((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
        at = at.select(*parts, "__r", "__prefix", (F.col("__rank") - F.col("__before")).alias("__rank"))
        if bits == 64:
            break
        inside = rows.withColumn("__prefix", F.shiftright("__key", 64 - bits))
        held = match_keys(inside, F.broadcast(at) if few else at, [*parts, "__prefix"], "inner", known=["__j", "__prefix"])
        counted = held.groupBy(*parts, "__r", "__rank", F.shiftright("__key", 64 - DIGIT - bits).alias("__prefix")).agg(F.count(F.lit(1)).alias("__n"))

    def median(j: int) -> Column:
        low, high = (F.max(F.when((F.col("__j") == j) & (F.col("__r") == r), key_value(F.col("__prefix")))) for r in (0, 1))
        return (low + high) / 2

    return at.groupBy(*keys).agg(*[median(j).alias(n) for j, n in enumerate(names)])


def aggregate_with_medians(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    medians: dict[str, Column],
    max_group_rows: int | None = None,
) -> DataFrame:
    """``groupBy(keys).agg(aggregates)`` plus exact medians.

    The built-in median buffers a group's values in one task, so it is used for groups
    of a checked size only; those of larger groups are found by digits, counted over many tasks.
    """
    if not medians:
        return df.groupBy(*keys).agg(*aggregates)
    medians = {name: to_number(column) for name, column in medians.items()}  # NaN is missing in either form
    if not keys:
        exact = exact_quantiles(df.select(*[c.alias(n) for n, c in medians.items()]), list(medians), [0.5])
        return df.agg(*aggregates, *[F.lit(exact[n][0]).cast("double").alias(n) for n in medians])
    if max_group_rows is None:
        max_group_rows = MEDIAN_BUFFER_ROWS // len(medians)
    n_hot = count_hot_groups(df, keys, max_group_rows)
    if n_hot == 0:
        return df.groupBy(*keys).agg(*aggregates, *[F.median(c).alias(n) for n, c in medians.items()])
    values = df.select(*keys, *[c.cast("double").alias(n) for n, c in medians.items()])
    hot = hot_keys(df, keys, max_group_rows, n_hot)
    large = match_keys(values, hot, keys, "left_semi")
    small = match_keys(values, hot, keys, "left_anti")
    of_small = small.groupBy(*keys).agg(*[F.median(name).alias(name) for name in medians])
    of_large = _medians_by_digits(large, keys, list(medians), n_hot <= BROADCAST_KEYS)
    return match_keys(df.groupBy(*keys).agg(*aggregates), of_small.unionByName(of_large), keys, "left")
