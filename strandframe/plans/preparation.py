"""Raw condition table to model-ready rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..columns import GROUP, POSITION, target_for
from ..operators.clean import clean, prepare_target
from ..operators.features import add_codes, add_group_columns, add_neighbors
from ..operators.filters import filter_groups
from ..operators.splits import split_groups
from ..sources.checks import require_columns


def process_features(
    df: DataFrame, target: str, features: Sequence[str], k: int = 0, order: Sequence[str] = (POSITION,), **limits
) -> DataFrame:
    """Clean, encode, add group columns, prepare the target, add neighbours."""
    ready = prepare_target(add_group_columns(add_codes(clean(df))), target)
    return add_neighbors(ready, features, k, order=order, **limits)


def prepare(
    df: DataFrame,
    condition: int | str,
    features: Sequence[str],
    k: int = 0,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    minimum: int = 0,
    maximum: int | None = None,
    order: Sequence[str] = (POSITION,),
    **limits,
) -> DataFrame:
    """Check, process, then filter groups: fills still see the groups filtered out."""
    checked = require_columns(df, condition)
    processed = process_features(checked, target_for(condition), features, k, order, **limits)
    return filter_groups(processed, include, exclude, minimum, maximum)


def prepare_and_split(df: DataFrame, condition: int | str, features: Sequence[str], k: int = 0,
                      seed: int = 42, test_size: float = 0.2, validation_size: float = 0.15, **options) -> DataFrame:
    prepared = prepare(df, condition, features, k, **options)
    return split_groups(prepared, test_size, validation_size, seed, group=GROUP)
