"""Row and group filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import GROUP, POSITION
from .features import with_group_statistics
from .skew import match_keys

# Longer lists become a join instead of an IN predicate.
INLINE_KEYS = 1000


def _is_in(df: DataFrame, column: str, keys: Sequence | DataFrame, how: str) -> DataFrame:
    """Null is in no list, whatever the list holds and however long it is."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias(column)).filter(F.col(column).isNotNull()).distinct()
        return match_keys(df, wanted, [column], how)
    keys = {k for k in keys if k is not None}
    if len(keys) > INLINE_KEYS:
        wanted = df.sparkSession.createDataFrame([(k,) for k in keys], df.select(column).schema)
        return match_keys(df, wanted, [column], how)
    listed = F.coalesce(F.col(column).isin(*keys), F.lit(False)) if keys else F.lit(False)
    return df.filter(listed if how == "left_semi" else ~listed)


def include_groups(df: DataFrame, keys: Sequence | DataFrame, group: str = GROUP) -> DataFrame:
    """Rows of the listed groups; an empty list keeps all."""
    if not isinstance(keys, DataFrame) and not keys:
        return df
    return _is_in(df, group, keys, "left_semi")


def exclude_groups(df: DataFrame, keys: Sequence | DataFrame, group: str = GROUP) -> DataFrame:
    """Rows outside the listed groups; rows without a group stay."""
    if not isinstance(keys, DataFrame) and not keys:
        return df
    return _is_in(df, group, keys, "left_anti")


def filter_group_size(
    df: DataFrame, minimum: int = 0, maximum: int | None = None, group: str = GROUP
) -> DataFrame:
    """Rows of groups within the size bounds, both inclusive."""
    if minimum <= 0 and maximum is None:
        return df
    sized = with_group_statistics(df, {"__rows": F.count(F.lit(1))}, group)
    keep = F.col("__rows") >= minimum
    if maximum is not None:
        keep &= F.col("__rows") <= maximum
    return sized.filter(keep).drop("__rows")


def filter_groups(
    df: DataFrame,
    include: Sequence | DataFrame = (),
    exclude: Sequence | DataFrame = (),
    minimum: int = 0,
    maximum: int | None = None,
    group: str = GROUP,
) -> DataFrame:
    """Include, exclude, then size. Runs after fills and neighbour features.

    Fill statistics are fitted constants by then, so they still cover removed groups.
    """
    kept = exclude_groups(include_groups(df, include, group), exclude, group)
    return filter_group_size(kept, minimum, maximum, group)


def complete_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def positive_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter((F.col(a) > 0) & (F.col(b) > 0))


def around_position(anchor: Column | int, reach: int, position: str = POSITION) -> Column:
    """Predicate: at most ``reach`` positions from the anchor, never below 0."""
    anchor = anchor if isinstance(anchor, Column) else F.lit(anchor)
    return F.col(position).between(F.greatest(F.lit(0), anchor - reach), anchor + reach)
