"""Group sizes, hot groups and null-safe key joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one group that a single task may order or buffer.
HOT_GROUP_ROWS = 5_000_000
# Counted keys that may be broadcast.
BROADCAST_KEYS = 200_000


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_hot_groups(df: DataFrame, keys: Sequence[str], max_rows: int = HOT_GROUP_ROWS) -> int:
    """Number of groups above ``max_rows``; reads the key columns alone, combined before the shuffle."""
    sizes = group_sizes(df.select(*keys), keys, "__rows")
    return sizes.agg(F.count_if(F.col("__rows") > max_rows)).first()[0]


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int, count: int) -> DataFrame:
    """The keys of hot groups, ``count`` of them as counted before.

    They are sent to every task while few, so that picking out the hot rows does not
    itself gather a hot group in one place.
    """
    found = group_sizes(df, keys, "__rows").filter(F.col("__rows") > max_rows).select(*keys)
    return F.broadcast(found) if count <= BROADCAST_KEYS else found


def match_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, known: Sequence[str] = ()
) -> DataFrame:
    """Join on keys where null matches null; the left side's key columns are kept.

    ``known`` lists the keys that are never null, which compare more cheaply. No hint:
    adaptive execution broadcasts a side it has measured as small and splits hot keys
    otherwise.
    """
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__right_{k}") for k in keys],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )

    def same(key: str):
        a, b = left[f"`{key}`"], renamed[f"`__right_{key}`"]
        return a == b if key in known else a.eqNullSafe(b)

    condition = reduce(lambda a, b: a & b, [same(k) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])
