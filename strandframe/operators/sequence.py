"""Sequence complexity in a sliding window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import CATEGORY, GROUP, POSITION, offset_name, offsets
from ..functions.codes import UNKNOWN_LETTER, one_letter
from .features import neighbor_columns


def sequence_complexity(
    df: DataFrame,
    window_size: int = 5,
    category: str = CATEGORY,
    group: str = GROUP,
    order: Sequence[str] = (POSITION,),
    three_letter: bool = True,
    name: str = "complexity",
    **limits,
) -> DataFrame:
    """Shannon entropy of the categories around each position, scaled by its maximum.

    The window holds ``window_size // 2`` positions on each side, ends padded with 'X'.
    An even size spans one position more than it divides by.
    """
    half = window_size // 2
    letter = one_letter(F.col(category)) if three_letter else F.coalesce(category, F.lit(UNKNOWN_LETTER))
    lettered = df.withColumn("__letter", letter)
    around = neighbor_columns(lettered, ["__letter"], half, group, order, **limits)
    letters = F.array(
        *[
            F.coalesce(offset_name("__letter", i), F.lit(UNKNOWN_LETTER)) if i else F.col("__letter")
            for i in range(-half, half + 1)
        ]
    )
    maximum = math.log2(min(20, window_size))
    if maximum > 0:
        shares = F.transform(
            F.array_distinct("__letters"),
            lambda x: F.size(F.filter("__letters", lambda y: y == x)) / F.lit(float(window_size)),
        )
        entropy = F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p)) / F.lit(maximum)
    else:
        entropy = F.lit(0.0)
    return (
        around.withColumn("__letters", letters)
        .withColumn(name, entropy)
        .drop("__letter", "__letters", *[offset_name("__letter", i) for i in offsets(half)])
    )
