"""Results of all conditions to the cross-condition tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..columns import CATEGORY, CONDITION, KEYS, STRUCTURE
from ..functions.codes import STRUCTURE_LABELS
from ..operators import conditions as across
from ..operators import trends as trend
from ..sources.checks import duplicate_keys
from ..sources.kept import Kept


def align(long: DataFrame, conditions: Sequence[int | str], models: Sequence[str], **options) -> DataFrame:
    """Aligned table; repeated keys are looked for first and switch to the join form."""
    repeated = not duplicate_keys(long, [*KEYS, CONDITION]).limit(1).isEmpty()
    return across.align_conditions(long, conditions, models, unique_keys=not repeated, **options)


def comparison_tables(
    long: DataFrame,
    wide: DataFrame,
    conditions: Sequence[int | str],
    models: Sequence[str],
    bins: int = 10,
    binned: Sequence[str] = ("relative_accessibility", "normalized_resid"),
    keep: Kept | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Named result tables, built when called. ``long`` and ``wide`` should be persisted.

    ``keep`` writes the fitted trends, which three tables read, once; its tables go when it is released.
    """
    primary = models[0]
    fitted: list[DataFrame] = []

    def trends() -> DataFrame:
        if not fitted:
            found = trend.position_trends(long, conditions)
            fitted.append(keep(found) if keep else found)
        return fitted[0]

    tables: dict[str, Callable[[], DataFrame]] = {
        "combined_predictions": lambda: wide,
        "actual_correlations": lambda: across.condition_correlations(wide, conditions),
        **{
            f"predicted_{m}_correlations": lambda m=m: across.condition_correlations(wide, conditions, f"{m}_pred") for m in models
        },
        "temperature_metrics": lambda: across.condition_metrics(long, models),
        "domain_trends": trends,
        "residue_outliers": lambda: trend.trend_outliers(trends()),
        "domain_stats": lambda: trend.group_trends(trends()),
        "aa_responses": lambda: trend.category_trends(trends()),
        "aa_error_summary": lambda: across.grouped_errors(wide, CATEGORY, conditions, models),
        "domain_performance": lambda: across.group_performance_by_condition(wide, conditions, models),
        "histogram_data": lambda: across.pooled_histogram(wide, conditions, primary),
    }
    if STRUCTURE in wide.columns:
        tables["ss_error_summary"] = lambda: across.structure_errors(
            wide, STRUCTURE, conditions, models, STRUCTURE_LABELS
        )
    usable = across.features_to_bin(wide, conditions)
    for feature in (f for f in binned if f in usable):
        tables[f"error_by_{feature}_bins"] = lambda f=feature: across.binned_errors(
            wide, f, conditions, models, bins
        )
    return tables
