"""Two-sided p-value of Student's t as a plain expression.

The tail is the regularised incomplete beta function I_x(a, b) at x = v / (v + t^2), a = v / 2 and b = 1 / 2.  Its
continued fraction is worked out from its STEPS-th term back to the first, which is one fold over a sequence; the
ratio of gamma functions before it comes from its asymptotic series at a point SHIFT further up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the fraction (its error is below 1e-12 up to some ten thousand degrees of freedom), and steps up for the series.
STEPS, SHIFT = 400, 32
#: Series of gamma(z + 1/2) / gamma(z) / sqrt(z) in 1 / z.
_SERIES = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)


def _gamma_ratio(v: Column) -> Column:
    """gamma((v + 1) / 2) / gamma(v / 2)."""
    z = v / 2 + SHIFT
    series = F.lit(0.0)
    for c in reversed(_SERIES):
        series = series / z + F.lit(c)
    down = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda p, j: p * (v + 2 * j) / (v + 2 * j + 1))
    return F.sqrt(z) * series * down


def _fraction(a: Column, b: Column, x: Column) -> Column:
    def term(i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(STEPS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, i: F.lit(1.0) + term(i) / f)


def two_sided_p(t: str, n: str) -> Column:
    """Probability that n values without a mean give a t statistic so far from 0; null where t is, or n is below 2."""
    t_, v = F.col(t).cast("double"), (F.col(n) - 1).cast("double")
    a, b, x, rest = v / 2, F.lit(0.5), v / (v + t_ * t_), t_ * t_ / (v + t_ * t_)
    front = _gamma_ratio(v) / math.sqrt(math.pi) * F.exp(a * F.ln(x) + b * F.ln(rest))
    # the fraction converges fast on one side of (a + 1) / (a + b + 2); on the other the arguments change places
    p = F.when(x < (a + 1) / (a + b + 2), front / (a * _fraction(a, b, x))).otherwise(1 - front / (b * _fraction(b, a, rest)))
    return F.when((F.col(n) >= 2) & ~F.isnan(t_), F.when(t_ == 0, 1.0).when(F.abs(t_) == float("inf"), 0.0).otherwise(p))


def two_sided_p_sql(t: str, n: str) -> str:
    """The same for whole degrees of freedom by their finite series in sines and cosines, to check it."""
    v, angle = f"({n} - 1)", f"atan(abs({t}) / sqrt(CAST({n} - 1 AS DOUBLE)))"
    y = f"pow(cos({angle}), 2)"
    series = lambda top, ratio: f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(CAST({top} AS BIGINT), 0, -1), lambda k: k::DOUBLE)), lambda s, k: 1 + {ratio} * {y} * s)"
    odd = f"2 / pi() * ({angle} + CASE WHEN {v} > 1 THEN sin({angle}) * cos({angle}) * {series(f'({v} - 3) // 2', '2 * k / (2 * k + 1)')} ELSE 0 END)"
    even = f"sin({angle}) * {series(f'({v} - 2) // 2', '(2 * k - 1) / (2 * k)')}"
    return f"CASE WHEN {n} >= 2 THEN 1 - CASE WHEN {v} % 2 = 1 THEN {odd} ELSE {even} END END"
