"""Per-position trend over numeric conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CATEGORY, CONDITION, GROUP, POSITION, numeric_conditions
from ..functions.significance import slope_p_value


def position_trends(
    long: DataFrame,
    conditions: Sequence[int | str],
    actual: str = "actual",
    group: str = GROUP,
    position: str = POSITION,
    category: str = CATEGORY,
) -> DataFrame:
    """Least-squares line of the actual value over temperature, per (group, position).

    At least two points and a value that changes are needed. If a position is listed
    under several categories, the smallest one is used.
    """
    levels = numeric_conditions(conditions)
    points = long.select(
        group, position, category, F.col(CONDITION).try_cast("int").alias("__t"), F.col(actual).alias("__y")
    ).filter(F.col("__t").isin(*levels) & F.col("__y").isNotNull() & F.col(group).isNotNull())
    x, y = F.col("__t").cast("double"), F.col("__y")
    # one shuffle on (group, position) serves both aggregates
    fitted = (
        points.repartition(group, position)
        .groupBy(group, position, category)
        .agg(
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r_squared"),
            F.count(y).alias("__n"),
            F.min(y).alias("__low"),
            F.max(y).alias("__high"),
        )
    )
    values = F.struct(category, "slope", "intercept", "r_squared", "__n", "__low", "__high")
    first = fitted.groupBy(group, position).agg(F.min_by(values, F.struct(F.col(category))).alias("__v"))
    usable = first.select(group, position, "__v.*").filter(
        (F.col("__n") > 1) & (F.col("__low") < F.col("__high"))
    )
    p = slope_p_value(F.col("r_squared"), F.col("__n"), len(levels))
    return usable.select(group, position, category, "slope", "intercept", "r_squared", p.alias("p_value"))


def trend_threshold(trends: DataFrame) -> Column:
    """Mean slope plus two population standard deviations, as a one-row part of the plan."""
    return trends.agg((F.avg("slope") + 2 * F.stddev_pop("slope")).alias("threshold")).scalar()


def _outlying(threshold: Column) -> Column:
    return (F.col("slope") < 0) | F.coalesce(F.col("slope") > threshold, F.lit(False))


def trend_outliers(
    trends: DataFrame, group: str = GROUP, position: str = POSITION, category: str = CATEGORY
) -> DataFrame:
    """Falling trends and unusually steep ones.

    ``trends`` are read for the threshold and for the rows: give a written table to fit them once.
    """
    behavior = F.when(F.col("slope") < 0, "negative_trend").otherwise("high_increase")
    return trends.filter(_outlying(trend_threshold(trends))).select(
        group, position, category, "slope", "r_squared", behavior.alias("behavior")
    )


def _trend_statistics() -> list[Column]:
    return [
        F.avg("slope").alias("avg_slope"),
        F.stddev_pop("slope").alias("std_slope"),
        F.avg("r_squared").alias("avg_r_squared"),
        F.count(F.lit(1)).alias("num_residues_analyzed"),
    ]


def group_trends(trends: DataFrame, group: str = GROUP) -> DataFrame:
    """Trend statistics and outlier count per group, in one aggregate; ``trends`` as for ``trend_outliers``."""
    marked = trends.withColumn("__outlying", _outlying(trend_threshold(trends)))
    return marked.groupBy(group).agg(*_trend_statistics(), F.count_if("__outlying").alias("outliers_count"))


def category_trends(trends: DataFrame, category: str = CATEGORY) -> DataFrame:
    return trends.groupBy(category).agg(*_trend_statistics())
