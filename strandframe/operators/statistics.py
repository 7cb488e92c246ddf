"""Count, mean, standard deviation and exact median of columns per group, from one pass and for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import ratio, to_number
from .radix import sort_key
from .skew import match_keys

# Leading bits of a value's sort key that make its bucket: sign, exponent and 12 bits of the fraction.
BUCKET_BITS = 24


def _lower_edge(bucket: Column) -> Column:
    """A number at most a bucket's width from all of its values; 0.0 around zero."""
    key = F.shiftleft(bucket, 64 - BUCKET_BITS)
    size = F.abs(key)
    fraction = size.bitwiseAND((1 << 52) - 1) / float(2**52)
    value = F.pow(F.lit(2.0), F.shiftright(size, 52) - 1023) * (1 + fraction)
    return F.when(size < (1 << 52), 0.0).when(size >= (0x7FF << 52), 0.0).otherwise(F.when(key < 0, -value).otherwise(value))


def group_statistics(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column | str]) -> DataFrame:
    """(keys, count, and {name}_mean, {name}_std, {name}_median per column) of every group.

    Values are counted by group, column and value bucket, combined before the shuffle; ``df`` is read once. A
    bucket is a fixed function of the value, in its order, so a running sum over the buckets of a group
    finds the one or two that hold the median, and only their values are ordered: a group may hold any
    share of the rows. The standard deviation is that of a sample; it and the mean add up from bucket
    to bucket around a number near the bucket's values. Missing values and NaN do not count, rows do; null
    keys are a group.
    """
    entries = [F.struct(F.lit(-1).alias("__j"), F.lit(None).cast("double").alias("__v"))]
    for j, column in enumerate(columns.values()):
        value = to_number(column) + F.lit(0.0)  # -0.0 becomes the 0.0 that it equals
        entries.append(F.when(value.isNotNull(), F.struct(F.lit(j).alias("__j"), value.alias("__v"))))
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.inline(F.array_compact(F.array(*entries))))
    bucket = F.shiftright(sort_key(F.col("__v"), T.DoubleType()), 64 - BUCKET_BITS)
    parts = [*keys, "__j"]
    counted = rows.withColumn("__bucket", F.coalesce(bucket, F.lit(0).cast("long"))).groupBy(*parts, "__bucket", "__v").agg(F.count(F.lit(1)).alias("__n"))

    off = F.col("__v") - _lower_edge(F.col("__bucket"))
    sums = counted.groupBy(*parts, "__bucket").agg(
        F.sum("__n").alias("__n"),
        F.sum(F.col("__n") * F.col("__v")).alias("__s"),
        F.sum(F.col("__n") * off).alias("__d"),
        F.sum(F.col("__n") * off * off).alias("__dd"),
    )
    group = Window.partitionBy(*parts)  # rows are buckets here
    n, total = F.sum("__n").over(group), F.sum("__s").over(group)
    earlier = F.coalesce(F.sum("__n").over(group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.select("*", n.alias("__all"), (total / n).alias("__mean"), earlier.alias("__start"))
    apart = F.col("__s") / F.col("__n") - F.col("__mean")
    spread = F.col("__dd") - F.col("__d") * F.col("__d") / F.col("__n") + F.col("__n") * apart * apart
    moments = placed.groupBy(*parts).agg(
        F.first("__all").alias("__n"), F.first("__mean").alias("__mean"),
        F.when(F.first("__all") > 1, F.sqrt(F.greatest(F.lit(0.0), ratio(F.sum(spread), F.first("__all") - 1)))).alias("__std"),
    )
    low, high = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    # no condition on the parts: one that is pushed below the counts would have them made twice
    middle = placed.filter((F.col("__start") <= high) & (low < F.col("__start") + F.col("__n")))
    middle = middle.select(*parts, "__bucket", "__start", low.alias("__low"), high.alias("__high"))
    inside = match_keys(counted, middle, [*parts, "__bucket"], "inner", known=["__j", "__bucket"])
    upto = F.sum("__n").over(Window.partitionBy(*parts, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("__end", F.col("__start") + upto)
    holds = {r: F.max(F.when((F.col("__end") - F.col("__n") <= F.col(r)) & (F.col(r) < F.col("__end")), F.col("__v"))) for r in ("__low", "__high")}
    medians = inside.groupBy(*parts).agg(((holds["__low"] + holds["__high"]) / 2).alias("__median"))
    found = match_keys(moments, medians, parts, "left", known=["__j"])

    def of(j: int, value: str) -> Column:
        return F.max(F.when(F.col("__j") == j, F.col(value)))

    wide = [of(-1, "__n").alias("count")]
    for j, name in enumerate(columns):
        wide += [of(j, f"__{s}").alias(f"{name}_{s}") for s in ("mean", "std", "median")]
    return found.groupBy(*keys).agg(*wide)
