"""The two equal-width binning conventions.

``cut_*``: right-closed bins, lowest edge lowered by 0.1 % of the range.
``histogram_*``: left-closed bins, the last one closed on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import to_number


def value_range(df: DataFrame, column: str) -> tuple[float, float] | None:
    """Smallest and largest value, or None for an all-null column."""
    value = to_number(column)
    low, high = df.agg(F.min(value), F.max(value)).first()
    return None if low is None else (low, high)


def even_edges(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / n
    return [low + i * step for i in range(n)] + [high]


def cut_edges(low: float, high: float, n: int) -> list[float]:
    if low == high:
        margin = 0.001 * abs(low) if low != 0 else 0.001
        return even_edges(low - margin, high + margin, n)
    edges = even_edges(low, high, n)
    edges[0] -= (high - low) * 0.001
    return edges


def histogram_edges(low: float, high: float, n: int) -> list[float]:
    if low == high:
        low, high = low - 0.5, high + 0.5
    return even_edges(low, high, n)


def _edges_passed(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests], F.lit(0))


def cut_bin(value: Column, edges: list[float]) -> Column:
    inside = (value > edges[0]) & (value <= edges[-1])
    return F.when(inside, _edges_passed([value > F.lit(e) for e in edges[1:-1]]))


def histogram_bin(value: Column, edges: list[float]) -> Column:
    inside = (value >= edges[0]) & (value <= edges[-1])
    return F.when(inside, _edges_passed([value >= F.lit(e) for e in edges[1:-1]]))


def edge_at(bin_index: Column, edges: list[float], shift: int = 0) -> Column:
    """Left edge of a bin (``shift=1``: right edge)."""
    return F.array(*[F.lit(float(e)) for e in edges])[bin_index + shift]
