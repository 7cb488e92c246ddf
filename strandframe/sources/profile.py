"""Dataset profile: shape, groups, types, missing values, special columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import EXTERNAL_PREDICTIONS, GROUP
from ..operators.ranking import exact_quantiles


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, null count, null share in %. A single scan."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("num_rows"),
        *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"nulls_{i}") for i, n in enumerate(names)],
    )
    entries = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(df.schema[n].dataType.simpleString()).alias("type"),
            F.col(f"nulls_{i}").alias("null_count"),
            (F.try_divide(F.col(f"nulls_{i}"), F.col("num_rows")) * 100).alias("null_percentage"),
            F.lit(n.startswith("rmsf_")).alias("is_target"),
            F.lit(n in EXTERNAL_PREDICTIONS).alias("is_external_prediction"),
        )
        for i, n in enumerate(names)
    ]
    return counted.select("num_rows", F.inline(F.array(*entries)))


def group_profile(df: DataFrame, group: str = GROUP) -> DataFrame:
    """Number of groups and rows per group: smallest, largest, mean, median.

    A null group counts as one group but has no size.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    named = sizes.withColumn("size", F.when(F.col(group).isNotNull(), F.col("rows")))
    (median,) = exact_quantiles(named, ["size"], [0.5])["size"]
    return named.agg(
        F.count(F.lit(1)).alias("num_groups"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.avg("size").alias("mean_size"),
        F.lit(median).cast("double").alias("median_size"),
    )


def example_groups(df: DataFrame, n: int = 5, group: str = GROUP) -> DataFrame:
    """The ``n`` smallest group names (files have no row order to take "the first" from)."""
    return df.select(group).distinct().orderBy(group).limit(n)
