"""Missing values and target preparation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import EXTERNAL_PREDICTIONS
from ..functions.numeric import to_number

CONSTANT_FILLS = {
    "dssp": "C",
    "relative_accessibility": 0.5,
    "core_exterior": "core",
    "phi": 0.0,
    "psi": 0.0,
}


def fill_constants(df: DataFrame, fills: Mapping[str, str | float] = CONSTANT_FILLS) -> DataFrame:
    """Replace missing values; a numeric fill also makes its column numeric."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name) if isinstance(value, str) else to_number(name), F.lit(value))
            for name, value in fills.items()
            if name in df.columns
        }
    )


def fill_with_means(df: DataFrame, columns=EXTERNAL_PREDICTIONS) -> DataFrame:
    """Replace missing numbers by the mean over all rows, or 0.0 if nothing is known."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    means = df.agg(*[F.avg(to_number(c)).alias(c) for c in present]).first()
    return df.withColumns(
        {c: F.coalesce(to_number(c), F.lit(0.0 if means[c] is None else means[c])) for c in present}
    )


def clean(df: DataFrame) -> DataFrame:
    return fill_with_means(fill_constants(df))


def prepare_target(df: DataFrame, target: str) -> DataFrame:
    """Numeric target with missing values as 0.0; a missing column is an error."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    return df.withColumn(target, F.coalesce(to_number(target), F.lit(0.0)))
