"""Null-safe numeric column expressions. ANSI mode is assumed to be on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(column: Column | str) -> Column:
    """Number or null: unreadable text and NaN both count as missing."""
    c = F.col(column) if isinstance(column, str) else column
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def signed_error(predicted: Column, actual: Column) -> Column:
    return predicted - actual


def absolute_error(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual)


def z_score(predicted: Column, actual: Column, uncertainty: Column) -> Column:
    return ratio(F.abs(predicted - actual), uncertainty)


def both_positive(a: Column, b: Column) -> Column:
    return (a > 0) & (b > 0)


def complete(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def paired(a: Column, b: Column) -> tuple[Column, Column]:
    """The two columns with both values dropped where either is missing."""
    keep = complete(a, b)
    return F.when(keep, a), F.when(keep, b)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over complete pairs; null if a side is constant or n < 2.

    Written without ``corr``, which raises on a constant column under ANSI mode.
    """
    x, y = paired(a, b)
    r = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    within = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    return F.when((F.count(x) > 1) & r.isNotNull(), within)
