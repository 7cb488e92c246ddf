"""Scored rows to every single-run table. Score once, persist, feed all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..columns import EXTERNAL_PREDICTIONS, STRUCTURE
from ..operators import conditions as across
from ..operators import groups, reports
from ..operators.metrics import predicted_column, regression_metrics


def evaluation_tables(
    scored: DataFrame, actual: str, models: Sequence[str], keys: Sequence[str], external: bool = False
) -> dict[str, Callable[[], DataFrame]]:
    """Named result tables, built when called. ``scored`` should be persisted."""
    others = EXTERNAL_PREDICTIONS if external else ()
    tables: dict[str, Callable[[], DataFrame]] = {
        "evaluation_results": lambda: regression_metrics(
            scored, actual, {m: predicted_column(m) for m in models}
        ),
        "domain_metrics": lambda: groups.group_error_metrics(scored, actual, models, others),
        "residue_position_errors": lambda: groups.errors_by_position(scored, models),
        "amino_acid_errors": lambda: groups.errors_by_category(scored, models),
        "rmsf_distribution": lambda: across.run_histogram(scored, actual, models),
        "rmsf_scatter_data": lambda: reports.scatter_sample(scored, actual, models, keys),
        "domain_profile": lambda: reports.group_profile_rows(scored, actual, models),
    }
    if STRUCTURE in scored.columns:
        tables["secondary_structure_errors"] = lambda: groups.errors_by_structure(scored, models)
        for m in models:
            tables[f"error_response_surface_{m}"] = lambda m=m: reports.response_surface(scored, m)
            tables[f"structure_report_{m}"] = lambda m=m: reports.structure_report(scored, actual, m)
    return tables
