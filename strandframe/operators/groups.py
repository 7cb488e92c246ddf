"""Performance per group, and error summaries per category or bin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CATEGORY, GROUP, POSITION, SCALED_POSITION, STRUCTURE, SURFACE
from ..functions.bins import cut_bin, cut_edges, value_range
from ..functions.codes import STRUCTURE_NAMES, lookup
from ..functions.numeric import pearson
from .metrics import abs_error_column, mae, predicted_column, r2, rmse
from .statistics import group_statistics


def composition(df: DataFrame) -> list[Column]:
    """Row count and the share (in %) of surface and of each structure class."""
    result = [F.count(F.lit(1)).alias("num_residues")]
    if SURFACE in df.columns:
        result.append((F.avg(SURFACE) * 100).alias("percent_surface"))
    if STRUCTURE in df.columns:
        for code, name in STRUCTURE_NAMES.items():
            # shares are over known classes; a class that never occurs has 0
            share = F.avg((F.col(STRUCTURE) == code).cast("double")) * 100
            result.append(F.coalesce(share, F.lit(0.0)).alias(f"percent_{name}"))
    return result


def group_performance(
    df: DataFrame, actual: str, models: Sequence[str], group: str = GROUP
) -> DataFrame:
    """Per group: composition, and RMSE / MAE / R2 / Pearson per model."""
    y = F.col(actual)
    scores = []
    for m in models:
        p = F.col(predicted_column(m))
        scores += [
            rmse(y, p).alias(f"{m}_rmse"),
            mae(y, p).alias(f"{m}_mae"),
            r2(y, p).alias(f"{m}_r2"),
            pearson(y, p).alias(f"{m}_pearson"),
        ]
    named = df.filter(F.col(group).isNotNull())
    return named.groupBy(group).agg(*composition(df), *scores)


def group_error_metrics(
    df: DataFrame,
    actual: str,
    models: Sequence[str],
    external: Sequence[str] = (),
    group: str = GROUP,
) -> DataFrame:
    """Per group: RMSE / MAE / R2, mean and population std of the error, composition.

    ``external`` adds the correlation of predictions with other prediction columns.
    """
    y = F.col(actual)
    scores = []
    for m in models:
        p = F.col(predicted_column(m))
        scores += [
            rmse(y, p).alias(f"{m}_rmse"),
            mae(y, p).alias(f"{m}_mae"),
            r2(y, p).alias(f"{m}_r2"),
            F.avg(p - y).alias(f"{m}_mean_error"),
            F.stddev_pop(p - y).alias(f"{m}_std_error"),
        ]
        scores += [
            pearson(p, F.col(e)).alias(f"{m}_corr_with_{e}") for e in external if e in df.columns
        ]
    named = df.filter(F.col(group).isNotNull())
    return named.groupBy(group).agg(*scores, *composition(df))


def error_summary(
    df: DataFrame, key: str | Sequence[str], errors: Mapping[str, str], keep_null: bool = False
) -> DataFrame:
    """Per key: row count, and mean / median / sample std of each error column.

    ``errors`` maps an output prefix to its column; an empty prefix gives bare names.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df if keep_null else df.dropna(subset=keys)
    found = group_statistics(rows, keys, {f"e{i}": column for i, column in enumerate(errors.values())})
    columns = []
    for i, prefix in enumerate(errors):
        lead = f"{prefix}_" if prefix else ""
        columns += [F.col(f"e{i}_{s}").alias(f"{lead}{s}_error") for s in ("mean", "std", "median")]
    return found.select(*keys, "count", *columns)


def errors_by_category(df: DataFrame, models: Sequence[str], category: str = CATEGORY) -> DataFrame:
    return error_summary(df, category, {m: abs_error_column(m) for m in models})


def errors_by_structure(df: DataFrame, models: Sequence[str], structure: str = STRUCTURE) -> DataFrame:
    """Errors per structure class, shown by name (``unknown_<code>`` for other codes)."""
    summary = error_summary(df, structure, {m: abs_error_column(m) for m in models})
    name = F.coalesce(
        lookup(F.col(structure), STRUCTURE_NAMES), F.concat(F.lit("unknown_"), F.col(structure).cast("string"))
    )
    return summary.withColumn("secondary_structure", name).drop(structure)


def errors_by_position(
    df: DataFrame, models: Sequence[str], bins: int = 20, position: str | None = None
) -> DataFrame:
    """Errors per bin of the scaled position, or per raw position if there is none."""
    position = position or (SCALED_POSITION if SCALED_POSITION in df.columns else POSITION)
    errors = {m: abs_error_column(m) for m in models}
    if position == POSITION:
        return error_summary(df, POSITION, errors)
    span = value_range(df, position)
    edges = cut_edges(*(span or (0.0, 1.0)), bins)
    binned = df.withColumn("resid_bin", cut_bin(F.col(position), edges))
    return error_summary(binned, "resid_bin", errors)


