"""Robust statistics as aggregate expressions; NULL is the mark of what was not measured."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard deviations in a median absolute deviation of normal noise.
MAD_SCALE = 1.4826
#: Fewest values for a floor.
LEAST_PIXELS = 6


def finite(x: Column) -> Column:
    """True where a value was measured: neither NULL, NaN nor infinite."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))


def measured(x: Column) -> Column:
    return F.when(finite(x), x)


def median(x: Column) -> Column:
    """Exact median with linear interpolation, over measured values."""
    return F.percentile(x, F.lit(0.5))


def sigma_of_deviation(deviation: Column) -> Column:
    """Robust sigma from absolute deviations about the group's median."""
    return F.lit(MAD_SCALE) * F.percentile(deviation, F.lit(0.5))


def floor_rate(sigma: Column, span_days: Column) -> Column:
    """Three sigma over the span; NULL unless the span is positive."""
    return F.when(span_days > 0, 3 * sigma / span_days)


def at_least(n: Column, least: int, value: Column) -> Column:
    """A statistic, refused (NULL) below a sample size."""
    return F.when(n >= least, value)


def percentile_name(point: float) -> str:
    return f"p{round(100 * point):g}"


def coverage(valid: Column, total: Column) -> Column:
    """Percent of a stated denominator; the area's and the frame's are never interchanged."""
    return F.try_divide(100.0 * valid, total)


def worst(x: Column) -> Column:
    """Largest measured value; NaN must not win, and no value gives NULL."""
    return F.max(measured(x))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to 1.2e-7 relative: a rational Chebyshev fit in t = 1 / (1 + x / 2)."""
    # fixed values: the published coefficients of the fit
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + x / 2)
    inner = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        inner = inner * t + c
    return t * F.exp(inner - x * x)


# fixed values: two-sided 95 % points of Student's t by degrees of freedom
T_95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201,
    12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 25: 2.060, 30: 2.042,
}


def t_critical(dof: Column) -> Column:
    """95 % point of Student's t: the largest listed degrees of freedom not above ``dof``, 1.96 beyond 30, NULL for none."""
    out = F.when(dof <= 0, F.lit(None).cast("double")).when(dof > 30, F.lit(1.960))
    for k in sorted(T_95, reverse=True):
        out = out.when(dof >= k, F.lit(T_95[k]))
    return out


def t_critical_value(dof: int) -> float:
    if dof <= 0:
        return math.nan
    return 1.960 if dof > 30 else T_95[max(k for k in T_95 if k <= dof)]


def half_even(x: Column, digits: int) -> Column:
    """Rounding half to even, as of the decimal form of a double."""
    return F.bround(x, digits)


def stars(p_value: Column) -> Column:
    """Significance marks; an undefined p has none."""
    return F.when(p_value < 0.001, "***").when(p_value < 0.01, "**").when(p_value < 0.05, "*").otherwise("")


def harmonic_revisit(repeat_days: Column) -> Column:
    """Aggregate: revisit of several tracks together."""
    return 1 / F.sum(1 / repeat_days)


def circular_mean(degrees: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    mean = F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))
    return F.pmod(F.degrees(mean) + 360, F.lit(360.0))


def upper_median(values: Column) -> Column:
    """Aggregate: the element at half the count of the sorted values, never interpolated."""
    ordered = F.array_sort(F.collect_list(values))
    return F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)
