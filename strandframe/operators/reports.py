"""Report extracts: the small tables behind plots, and top-k / reshaping helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CATEGORY, CONDITION, GROUP, POSITION, SCALED_POSITION, STRUCTURE, SURFACE
from ..functions.bins import cut_bin, cut_edges, value_range
from ..functions.codes import POSITION_LABELS, STRUCTURE_LABELS, SURFACE_LABELS, label
from .filters import around_position
from .groups import error_summary
from .metrics import abs_error_column, predicted_column
from .skew import group_sizes
from .splits import sample_rows


def top_importances(importances: DataFrame, n: int | None = 15) -> DataFrame:
    """Features by falling importance; ``n=None`` for all."""
    ordered = importances.orderBy(F.desc("importance"), "feature")
    return ordered if n is None else ordered.limit(n)


def largest_group(df: DataFrame, group: str = GROUP) -> DataFrame:
    """The group with the most rows; the smallest key wins a tie."""
    sizes = group_sizes(df.filter(F.col(group).isNotNull()), [group])
    return sizes.orderBy(F.desc("rows"), group).limit(1)


def best_model(metrics: DataFrame) -> str | None:
    """Model with the highest R2, else the lowest RMSE, else the first by name."""
    named = metrics.filter(F.col("model").isNotNull())
    if "r2" in metrics.columns:
        choice = F.max_by("model", F.struct("r2", F.col("model")))
        return named.filter(F.col("r2").isNotNull()).agg(choice).first()[0]
    if "rmse" in metrics.columns:
        choice = F.min_by("model", F.struct("rmse", F.col("model")))
        return named.filter(F.col("rmse").isNotNull()).agg(choice).first()[0]
    return named.agg(F.min("model")).first()[0]


def categories_by_median_error(df: DataFrame, error: str, category: str = CATEGORY) -> DataFrame:
    medians = error_summary(df, category, {"": error}).select(category, "median_error")
    return medians.orderBy("median_error", category)


def most_frequent_categories(df: DataFrame, n: int = 10, category: str = CATEGORY) -> DataFrame:
    sizes = group_sizes(df.filter(F.col(category).isNotNull()), [category], "count")
    return sizes.orderBy(F.desc("count"), category).limit(n)


def unpivot_conditions(wide: DataFrame, ids: Sequence[str], marker: str, value: str) -> DataFrame:
    """Columns containing ``marker`` as rows; the condition is the part after the last '_'."""
    columns = [c for c in wide.columns if marker in c]
    rows = wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), columns, "__name", value
    )
    return rows.withColumn(CONDITION, F.regexp_extract("__name", r"_([^_]+)$", 1)).withColumn(
        "metric", F.regexp_extract("__name", r"^(.*)_[^_]+$", 1)
    ).drop("__name")


def mean_over_conditions(wide: DataFrame, ids: Sequence[str], marker: str, name: str = "avg_error") -> DataFrame:
    """Row mean over the condition columns, missing ones skipped; highest first."""
    columns = [F.col(c) for c in wide.columns if marker in c]
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return wide.select(*ids, F.try_divide(total, known).alias(name)).orderBy(F.desc(name), *ids)


def group_profile_rows(df: DataFrame, actual: str, models: Sequence[str], group: str = GROUP) -> DataFrame:
    """Positions of the largest group with actual and predicted values."""
    columns = [group, POSITION, CATEGORY, actual, *[predicted_column(m) for m in models]]
    columns += [c for c in (STRUCTURE, SURFACE) if c in df.columns]
    chosen = largest_group(df, group).first()
    rows = df.filter(F.col(group) == chosen[group]) if chosen else df.filter(F.lit(False))
    return rows.select(*columns).orderBy(POSITION)


def category_errors(df: DataFrame, model: str, category: str = CATEGORY) -> DataFrame:
    return df.select(category, F.col(abs_error_column(model)).alias("error"))


def category_values(df: DataFrame, actual: str, model: str, category: str = CATEGORY) -> DataFrame:
    return df.select(
        category, F.col(actual).alias("actual"), F.col(predicted_column(model)).alias("predicted")
    )


def _position_edges(df: DataFrame, bins: int) -> list[float]:
    return cut_edges(*(value_range(df, SCALED_POSITION) or (0.0, 1.0)), bins)


def errors_by_property(df: DataFrame, model: str) -> DataFrame:
    """Errors by structure, by surface and by five named parts of the sequence, in one pass over the rows."""
    parts: list[tuple[str, Column]] = []
    if STRUCTURE in df.columns:
        parts.append(("secondary_structure", label(F.col(STRUCTURE), STRUCTURE_LABELS)))
    if SURFACE in df.columns:
        parts.append(("surface_exposure", label(F.col(SURFACE), SURFACE_LABELS)))
    if SCALED_POSITION in df.columns:
        placed = cut_bin(F.col(SCALED_POSITION), _position_edges(df, len(POSITION_LABELS)))
        parts.append(("sequence_position", label(placed, dict(enumerate(POSITION_LABELS)))))
    entries = F.array(*[F.struct(F.lit(name).alias("property"), value.alias("value")) for name, value in parts])
    error = abs_error_column(model)
    rows = df.select(F.col(error), F.inline(entries)).filter(F.col("value").isNotNull())
    return error_summary(rows, ["property", "value"], {"": error}).select("property", "value", "count", "mean_error", "median_error", "std_error")


def model_pairs(df: DataFrame, actual: str, models: Sequence[str]) -> dict[tuple[str, str], DataFrame]:
    """Per pair of models: actual value and both predictions."""
    return {
        (a, b): df.select(F.col(actual).alias("actual"), predicted_column(a), predicted_column(b))
        for a, b in combinations(models, 2)
    }


def actual_and_predicted(df: DataFrame, actual: str, model: str) -> DataFrame:
    return df.select(F.col(actual).alias("actual"), F.col(predicted_column(model)).alias("predicted"))


def angles_and_values(df: DataFrame, actual: str, model: str) -> DataFrame:
    return df.select(
        F.col("phi_norm").alias("phi"),
        F.col("psi_norm").alias("psi"),
        F.col(actual).alias("actual"),
        F.col(predicted_column(model)).alias("predicted"),
    )


def extreme_neighborhood(
    df: DataFrame,
    actual: str,
    model: str | None = None,
    reach: int = 10,
    minimum: int = 50,
    group: str = GROUP,
) -> DataFrame:
    """Rows around the highest value of the first group with at least ``minimum`` rows.

    "First" is the smallest key; of equal highest values the smallest position counts.
    """
    columns = [group, POSITION, CATEGORY, actual]
    columns += [STRUCTURE] if STRUCTURE in df.columns else []
    columns += [predicted_column(model)] if model else []
    sizes = group_sizes(df.filter(F.col(group).isNotNull()), [group])
    key = sizes.filter(F.col("rows") >= minimum).agg(F.min(group)).first()[0]
    if key is None:
        return df.select(*columns).filter(F.lit(False))
    rows = df.filter(F.col(group) == key)
    anchor = rows.filter(F.col(actual).isNotNull()).agg(
        F.max_by(POSITION, F.struct(F.col(actual), -F.col(POSITION)))
    ).first()[0]
    return rows.filter(around_position(anchor, reach)).select(*columns).orderBy(POSITION)


def response_surface(df: DataFrame, model: str, bins: int = 10) -> DataFrame:
    """Mean absolute error and row count per position bin and structure code."""
    placed = df.withColumn("position_bin", cut_bin(F.col(SCALED_POSITION), _position_edges(df, bins)))
    return (
        placed.filter(F.col("position_bin").isNotNull() & F.col(STRUCTURE).isNotNull())
        .groupBy("position_bin", F.col(STRUCTURE).alias("secondary_structure"))
        .agg(F.avg(abs_error_column(model)).alias("mean_error"), F.count(F.lit(1)).alias("count"))
    )


def surface_matrix(surface: DataFrame, bins: int = 10) -> DataFrame:
    """Structure x position bin matrix of mean errors."""
    return surface.groupBy("secondary_structure").pivot("position_bin", list(range(bins))).agg(F.first("mean_error"))


def structure_report(df: DataFrame, actual: str, model: str) -> DataFrame:
    error = abs_error_column(model)
    return (
        df.filter(F.col(STRUCTURE).isNotNull())
        .groupBy(STRUCTURE)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(actual).alias("mean_actual"),
            F.avg(predicted_column(model)).alias("mean_predicted"),
            F.avg(error).alias("mean_error"),
            F.stddev_samp(error).alias("std_error"),
        )
        .withColumn("secondary_structure", label(F.col(STRUCTURE), STRUCTURE_LABELS))
        .drop(STRUCTURE)
    )


def scatter_sample(
    df: DataFrame, actual: str, models: Sequence[str], keys: Sequence[str], n: int = 5000, seed: int = 42
) -> DataFrame:
    """At most ``n`` rows with actual and predicted values and structure columns."""
    extras = [c for c in (STRUCTURE, SURFACE, SCALED_POSITION) if c in df.columns]
    return sample_rows(df, n, keys, seed).select(
        GROUP, POSITION, CATEGORY, F.col(actual).alias("actual"),
        *[F.col(predicted_column(m)).alias(m) for m in models], *extras,
    )


def training_curve(history: DataFrame) -> DataFrame:
    """(epoch, train_*, val_*) from (epoch, part, metric, value)."""
    named = history.withColumn("name", F.concat_ws("_", "part", "metric"))
    return named.groupBy("epoch").pivot("name").agg(F.first("value")).orderBy("epoch")


def condition_report(metrics: DataFrame) -> DataFrame:
    """RMSE, R2 and Pearson correlation per condition and model."""
    return metrics.select(CONDITION, "model", "rmse", "r2", "pearson_correlation").orderBy(CONDITION, "model")
