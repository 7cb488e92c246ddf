"""Checks made before a table is used."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import KEYS, REQUIRED_TEMPLATES, for_condition


def missing_columns(df: DataFrame, required: Iterable[str], condition: int | str = "") -> list[str]:
    wanted = [for_condition(name, condition) for name in required]
    return [name for name in wanted if name not in df.columns]


def require_columns(
    df: DataFrame, condition: int | str, required: Iterable[str] = REQUIRED_TEMPLATES
) -> DataFrame:
    missing = missing_columns(df, required, condition)
    if missing:
        raise ValueError(f"missing required columns for condition {condition}: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)
