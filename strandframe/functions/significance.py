"""Two-sided p-values of correlation and slope tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail(theta: Column, dof: int) -> Column:
    """Two-sided t tail for a whole number of degrees of freedom.

    Closed trigonometric form in ``theta = atan(|t| / sqrt(dof))``.
    """
    sine, cosine = F.sin(theta), F.cos(theta)
    if dof % 2 == 1:
        body, weight = theta, 1.0
        for power in range(1, dof - 1, 2):
            weight *= (power - 1) / power if power > 1 else 1.0
            body = body + sine * F.pow(cosine, F.lit(power)) * F.lit(weight)
        return 1 - F.lit(2 / math.pi) * body
    body, weight = F.lit(1.0), 1.0
    for power in range(2, dof - 1, 2):
        weight *= (power - 1) / power
        body = body + F.pow(cosine, F.lit(power)) * F.lit(weight)
    return 1 - sine * body


def slope_p_value(r_squared: Column, n: Column, max_points: int) -> Column:
    """p-value of a least-squares slope fitted to ``n <= max_points`` points.

    Two points leave no freedom and always give 0; an exact fit gives 0 as well.
    """
    exact = r_squared >= 1.0
    result = F.when((n == 2) | exact, F.lit(0.0))
    for dof in range(1, max_points - 1):
        # |t| / sqrt(dof) = |r| / sqrt(1 - r^2)
        theta = F.atan2(F.sqrt(r_squared), F.sqrt(1 - r_squared))
        result = result.when(n == dof + 2, F.greatest(F.lit(0.0), _tail(theta, dof)))
    return result


# Steps of the continued fraction; it settles to the last digits within 50 for any number of rows.
FRACTION_STEPS = 64
# Small arguments are shifted up by so much before the series of the gamma ratio is used.
GAMMA_SHIFT = 16
# Coefficients of a^-1, a^-3, ... in log(gamma(a + 1/2) / gamma(a)) - log(a) / 2: fixed values.
GAMMA_SERIES = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)


def log_gamma_ratio(a: Column) -> Column:
    """log(gamma(a + 1/2) / gamma(a)) for positive ``a``."""
    shifted = a + GAMMA_SHIFT
    series = F.log(shifted) / 2
    power = 1 / shifted
    for coefficient in GAMMA_SERIES:
        series = series + F.lit(coefficient) * power
        power = power / (shifted * shifted)
    for i in range(GAMMA_SHIFT):
        series = series + F.log1p(-0.5 / (a + i + 0.5))
    return series


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's steps."""

    def away_from_zero(value: Column) -> Column:
        return F.when(F.abs(value) > 1e-300, value).otherwise(1e-300)

    def one(state: Column, term: Column) -> Column:
        d = 1 / away_from_zero(1 + term * state["d"])
        c = away_from_zero(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["value"] * c * d).alias("value"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return one(one(state, even), odd)

    first = 1 / away_from_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"))
    steps = F.array(*[F.lit(float(m)) for m in range(1, FRACTION_STEPS)])
    return F.aggregate(steps, start, step, lambda state: state["value"])


def correlation_p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs: the incomplete beta function of 1 - r^2
    at (n - 2) / 2 and 1 / 2.

    Null without a correlation or with fewer than two pairs; two pairs always give 1. 1 - r^2 is rounded,
    which makes small values uncertain by a share of about n * 1e-16.
    """
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    r, n = r.cast("double"), n.cast("double")
    half = (n - 2) / 2
    near, far = r * r, F.greatest(F.lit(0.0), 1 - r * r)
    # Of the two forms the one whose fraction settles fast; rows pass their numbers on once.
    direct = far < (half + 1) / (half + 2.5)
    chosen = F.struct(
        direct.alias("direct"),
        F.when(direct, half).otherwise(0.5).alias("a"),
        F.when(direct, F.lit(0.5)).otherwise(half).alias("b"),
        F.when(direct, far).otherwise(near).alias("x"),
        (log_gamma_ratio(half) - 0.5 * math.log(math.pi) + half * F.log1p(-near) + F.log(F.abs(r))).alias("front"),
    )

    def value(s: Column) -> Column:
        tail = F.exp(s["front"]) * _beta_fraction(s["a"], s["b"], s["x"]) / s["a"]
        return F.when(s["direct"], tail).otherwise(1 - tail)

    p = F.element_at(F.transform(F.array(chosen), value), 1)
    p = F.when(near >= 1, 0.0).when(near == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    known = r.isNotNull() & ~F.isnan(r) & (n >= 2)
    return F.when(known, F.when(n == 2, 1.0).otherwise(p))
