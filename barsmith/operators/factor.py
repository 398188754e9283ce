"""The factor operator library: 52 operators on columns of the dense panel.

An operator takes a plan and the names of its inputs and returns a column.  Axis
0 runs along time for each code, axis 1 across codes for each date.  Windowed
operators are null on their first window - 1 rows and ignore nulls inside a
window unless said otherwise; a window counts panel rows, so densify first.
"""

from __future__ import annotations

import inspect
import math
import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.decay import decay
from barsmith.functions.dialect import BY_CODE, BY_DATE, DATE, KEY, Duck, Spark, finite, ratio, rows, so_far
from barsmith.functions.histories import Groups, along
from barsmith.functions.spans import Series

OPERATORS: dict[str, Callable] = {}
#: Operators that prepare or finish a factor; a factor itself may not use them.
PROCESSING = ("neutralize", "winsorize", "clip", "fill_na", "cross_sectional_rank", "cross_sectional_scale")


def register_operator(name: str, build: Callable) -> None:
    """Make build(plan, ...) available to factor expressions under a name."""
    OPERATORS[name] = build


def operator_docs(spark: SparkSession) -> DataFrame:
    """(name, signature, doc) of every operator, for those who write expressions."""
    rows_ = [(n, f"({', '.join(list(map(str, inspect.signature(f).parameters.values()))[1:])})", inspect.getdoc(f) or "") for n, f in sorted(OPERATORS.items())]
    return spark.createDataFrame(rows_, "name string, signature string, doc string")


def operator(f: Callable) -> Callable:
    register_operator(f.__name__, f)
    return f


class FactorPlan:
    """Steps that add columns, one for each distinct sub-expression."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str, Any]] = []  # (kind, column, what)
        self.known: dict[Any, str] = {}

    def let(self, expr: str | Callable, kind: str = "expr") -> str:
        text = (kind, expr(Spark) if callable(expr) and kind != "fold" else expr if not isinstance(expr, tuple) else expr)
        if text not in self.known:
            name = f"f{len(self.known)}"
            self.known[text] = name
            self.steps.append((kind, name, expr))
        return self.known[text]

    def apply(self, df: DataFrame) -> DataFrame:
        left = self.steps
        while left:
            # statistics of the whole array that can be worked out by now share one aggregate; what needs them comes after it
            waiting: dict[str, str] = {}
            later, unknown = [], set()
            for kind, name, what in left:
                text = what[0] if kind in ("fold", "order") else what(Spark) if callable(what) else what
                if set(re.findall(r"\w+", text)) & unknown:
                    later.append((kind, name, what))
                elif kind == "whole":
                    waiting[name] = text
                elif kind in ("fold", "order"):
                    df = (_fold if kind == "fold" else _order_statistic)(df, name, *what)
                else:
                    df = df.selectExpr("*", f"{text} AS `{name}`")
                if kind == "whole" or (later and later[-1][1] == name):
                    unknown.add(name)
            if waiting:
                df = df.join(F.broadcast(df.agg(*(F.expr(e).alias(n) for n, e in waiting.items()))))  # one row
            left = later
        return df

    def sql(self, base: str, source: str, columns: list[str]) -> str:
        parts, prev = [base], source
        for i, (kind, name, what) in enumerate(self.steps):
            if kind == "expr":
                parts.append(f'fs{i} AS (SELECT *, {what(Duck) if callable(what) else what} AS "{name}" FROM {prev})')
            elif kind == "whole":
                parts.append(f'fs{i} AS (SELECT * FROM {prev} CROSS JOIN (SELECT {what(Duck)} AS "{name}" FROM {prev}))')
            elif kind == "order":
                parts.append(f'fs{i} AS (SELECT *, {_order_statistic_sql(*what)} AS "{name}" FROM {prev})')
            else:
                x, alpha, axis = what
                order = _order(axis)
                parts.append(f'fs{i} AS (SELECT *, CASE WHEN {x} IS NOT NULL THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({so_far(order)}), lambda a, v: {alpha!r} * v + (1 - {alpha!r}) * a) END AS "{name}" FROM {prev})')
            prev = f"fs{i}"
        return f"WITH {', '.join(parts)} SELECT {', '.join(columns)} FROM {prev}"


def _fold(df: DataFrame, name: str, x: str, alpha: float, axis: int) -> DataFrame:
    """Exponential average of a column; a gap gives null but keeps the state."""
    by, along = (KEY, DATE) if axis == 0 else (DATE, KEY)

    def each(t: pa.Table) -> pa.Table:
        t = t.sort_by(along)
        v = t.column(x).to_numpy().astype(float)
        known = ~np.isnan(v)
        out = np.full(len(v), np.nan)
        if known.any():
            out[known] = decay(v[known], alpha, v[known][0])
        return t.append_column(name, pa.array(out, pa.float64(), mask=~known))

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.groupBy(by).applyInArrow(each, f"{kinds}, `{name}` double")


def _order_statistic(df: DataFrame, name: str, x: str, window: int, share: float | None, axis: int) -> DataFrame:
    """A quantile of the last rows of a column, or its own rank among them from 0 to 1 with ties at their mean."""
    by, along_ = (KEY, DATE) if axis == 0 else (DATE, KEY)

    def made(groups: Groups) -> dict[str, np.ndarray]:
        series, (lo, hi) = Series(groups.values(x)), groups.last_rows(window)
        if share is not None:
            got = series.quantiles(lo, hi, [share])[0]
        else:
            a, b = series.inner(lo, hi)
            own = np.where(series.known, series.x, 0)
            less, upto = (series.ranks.up_to(a, b, own, strict)[0] for strict in (True, False))
            got = np.where(series.known & (b - a > 1), (less + (upto - less - 1) / 2) / np.maximum(b - a - 1, 1), np.nan)
        return {name: np.where(groups.no >= window, got, np.nan)}

    return along(df, [name], made, by, along_)


def _order_statistic_sql(x: str, window: int, share: float | None, axis: int) -> str:
    if share is not None:
        return _full(Duck.pct(x, share), window, axis)
    values = Duck.values(x, rows(window, _order(axis)))
    less, same, n = (Duck.count_in(values, t) for t in (f"v < {x}", f"v = {x}", "true"))
    return f"CASE WHEN row_number() OVER ({_order(axis)}) >= {window} AND {x} IS NOT NULL AND {n} > 1 THEN ({less} + ({same} - 1) / 2e0) / ({n} - 1) END"


def _order(axis: int) -> str:
    return BY_CODE if axis == 0 else BY_DATE


def _group(axis: int) -> str:
    return f"PARTITION BY {KEY if axis == 0 else DATE}"


def _full(expr: str, window: int, axis: int) -> str:
    """expr OVER a window of rows, null before the window is full."""
    return f"CASE WHEN row_number() OVER ({_order(axis)}) >= {window} THEN {expr} OVER ({rows(window, _order(axis))}) END"


@operator
def add(p, a, b):
    return p.let(f"{a} + {b}")


@operator
def subtract(p, a, b):
    return p.let(f"{a} - {b}")


@operator
def multiply(p, a, b):
    return p.let(f"{a} * {b}")


@operator
def divide(p, a, b):
    return p.let(ratio(a, b))


@operator
def log(p, a):
    return p.let(f"CASE WHEN {a} > 0 THEN ln(CAST({a} AS DOUBLE)) END")


@operator
def abs_val(p, a):
    return p.let(f"abs({a})")


@operator
def power(p, a, p_):
    return p.let(finite(f"power(CAST({a} AS DOUBLE), {p_})"))


@operator
def sqrt(p, a):
    return p.let(f"CASE WHEN {a} >= 0 THEN sqrt({a}) END")


@operator
def cumulative_sum(p, data, axis=0):
    return p.let(f"coalesce(sum({data}) OVER ({so_far(_order(axis))}), 0)")


def _product(x: str, over: str) -> str:
    """Product of a frame; a null counts as 1."""
    zeros, minus = f"sum(CASE WHEN {x} = 0 THEN 1 ELSE 0 END) OVER ({over})", f"sum(CASE WHEN {x} < 0 THEN 1 ELSE 0 END) OVER ({over})"
    size = f"exp(coalesce(sum(CASE WHEN {x} <> 0 THEN ln(abs({x})) END) OVER ({over}), 0e0))"
    return f"CASE WHEN {zeros} > 0 THEN 0e0 WHEN {minus} % 2 = 1 THEN - {size} ELSE {size} END"


@operator
def cumulative_product(p, data, axis=0):
    return p.let(_product(data, so_far(_order(axis))))


@operator
def cumulative_max(p, data, axis=0):
    return p.let(f"max({data}) OVER ({so_far(_order(axis))})")


@operator
def cumulative_min(p, data, axis=0):
    return p.let(f"min({data}) OVER ({so_far(_order(axis))})")


@operator
def rolling_sum(p, data, window, axis=0):
    return p.let(f"CASE WHEN row_number() OVER ({_order(axis)}) >= {window} THEN coalesce(sum({data}) OVER ({rows(window, _order(axis))}), 0) END")


@operator
def rolling_product(p, data, window, axis=0):
    return p.let(f"CASE WHEN row_number() OVER ({_order(axis)}) >= {window} THEN {_product(data, rows(window, _order(axis)))} END")


@operator
def rolling_max(p, data, window, axis=0):
    return p.let(_full(f"max({data})", window, axis))


@operator
def rolling_min(p, data, window, axis=0):
    return p.let(_full(f"min({data})", window, axis))


@operator
def rolling_std(p, data, window, axis=0):
    return p.let(_full(f"stddev_pop({data})", window, axis))


@operator
def mean(p, data, axis=0):
    return p.let(f"avg({data}) OVER ({_group(axis)})")


@operator
def variance(p, data, axis=0, ddof=1):
    g = f"OVER ({_group(axis)})"
    if ddof in (0, 1):
        return p.let(f"{'var_samp' if ddof else 'var_pop'}({data}) {g}")
    return p.let(f"CASE WHEN count({data}) {g} > {ddof} THEN var_pop({data}) {g} * count({data}) {g} / (count({data}) {g} - {ddof}) END")


@operator
def std_dev(p, data, axis=0, ddof=1):
    return p.let(f"sqrt({variance(p, data, axis, ddof)})")


def _both(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"


@operator
def correlation(p, a, b, axis=0):
    g = f"OVER ({_group(axis)})"
    return p.let(lambda d: f"CASE WHEN count({_both(a, b)}) {g} >= 2 THEN {finite(d.corr(a, b, g))} END")


@operator
def covariance(p, a, b, axis=0):
    g = f"OVER ({_group(axis)})"
    return p.let(f"CASE WHEN count({_both(a, b)}) {g} >= 2 THEN covar_samp({a}, {b}) {g} END")


@operator
def max_val(p, data, axis=0):
    return p.let(f"max({data}) OVER ({_group(axis)})")


@operator
def min_val(p, data, axis=0):
    return p.let(f"min({data}) OVER ({_group(axis)})")


@operator
def median(p, data, axis=0):
    return p.let(lambda d: f"{d.pct(data, 0.5)} OVER ({_group(axis)})")


@operator
def quantile(p, data, q, axis=0):
    if isinstance(q, list | tuple):
        return [quantile(p, data, one, axis) for one in q]
    return p.let(lambda d: f"{d.pct(data, q)} OVER ({_group(axis)})")


@operator
def excess_return(p, data, benchmark_data, axis=0):
    """Along time only; the benchmark is a column of the panel with one value a date."""
    if axis != 0:
        raise ValueError("an excess return runs along time")
    return p.let(f"{data} - {benchmark_data}")


@operator
def ts_delay(p, data, window, axis=0):
    return p.let(f"lag({data}, {window}) OVER ({_order(axis)})")


@operator
def ts_delta(p, data, window, axis=0):
    return p.let(f"{data} - lag({data}, {window}) OVER ({_order(axis)})")


@operator
def moving_average(p, data, window, axis=0):
    return p.let(_full(f"avg({data})", window, axis))


register_operator("ts_mean", moving_average)


@operator
def ts_std(p, data, window, axis=0):
    return rolling_std(p, data, window, axis)


@operator
def exponential_moving_average(p, data, span, axis=0):
    return p.let((data, 2 / (span + 1), axis), "fold")


@operator
def time_series_decay(p, data, halflife, axis=0):
    return p.let((data, 1 - math.exp(math.log(0.5) / halflife), axis), "fold")




def _shape(p, data, window, axis, power_, least):
    """Standardised moment of a window about its mean, from raw moments of values less a reference near them."""
    order = _order(axis)
    w = f"OVER ({rows(window, order)})"
    origin = p.let(f"avg({data}) OVER ({_group(axis)})")
    x = p.let(f"{data} - {origin}")
    m = [p.let(f"avg(power({x}, {k})) {w}") for k in (1, 2, 3, 4)]
    var = p.let(f"{m[1]} - power({m[0]}, 2)")
    third = f"{m[2]} - 3 * {m[0]} * {m[1]} + 2 * power({m[0]}, 3)"
    fourth = f"{m[3]} - 4 * {m[0]} * {m[2]} + 6 * power({m[0]}, 2) * {m[1]} - 3 * power({m[0]}, 4)"
    value = f"({third}) / power({var}, 1.5)" if power_ == 3 else f"({fourth}) / power({var}, 2) - 3"
    return p.let(f"CASE WHEN row_number() OVER ({order}) >= {window} AND count({data}) {w} >= {least} AND {var} > 1e-14 THEN {value} END")


@operator
def rolling_skew(p, data, window, axis=0):
    return _shape(p, data, window, axis, 3, 3)


@operator
def rolling_kurt(p, data, window, axis=0):
    return _shape(p, data, window, axis, 4, 4)


@operator
def rolling_quantile(p, data, window, quantile_level, axis=0):
    return p.let((data, int(window), float(quantile_level), axis), "order")


def _pairs(p, expr, a, b, window, axis, least=2):
    order = _order(axis)
    w = f"OVER ({rows(window, order)})"
    x, y = p.let(f"CASE WHEN {b} IS NOT NULL THEN {a} END"), p.let(f"CASE WHEN {a} IS NOT NULL THEN {b} END")
    made = expr if callable(expr) else lambda d, x, y, w: f"{expr.format(x=x, y=y)} {w}"
    return p.let(lambda d: f"CASE WHEN row_number() OVER ({order}) >= {window} AND count({x}) {w} >= {least} THEN {finite(made(d, x, y, w))} END")


@operator
def rolling_corr(p, a, b, window, axis=0):
    return _pairs(p, lambda d, x, y, w: d.corr(x, y, w), a, b, window, axis)


@operator
def rolling_cov(p, a, b, window, axis=0):
    return _pairs(p, "covar_samp({x}, {y})", a, b, window, axis)


@operator
def ts_rank(p, data, window, axis=0):
    return p.let((data, int(window), None, axis), "order")


@operator
def rolling_max_drawdown(p, data, window, axis=0):
    """Least of (cum - peak) / (1 + peak) over a window of returns; the peak starts at the first return."""
    order = _order(axis)
    grown = p.let(lambda d: d.values(f"(CASE WHEN {data} IS NOT NULL THEN 1e0 + {data} END)", rows(window, order)))
    return p.let(lambda d: f"CASE WHEN row_number() OVER ({order}) >= {window} THEN {_drawdown(d, grown)} END")


def _drawdown(d, grown: str) -> str:
    if d is Duck:
        return f"list_reduce(list_transform({grown}, lambda g: {{'wealth': g, 'peak': g, 'worst': 0e0}}), lambda s, g: {{'wealth': s.wealth * g.wealth, 'peak': greatest(s.peak, s.wealth * g.wealth), 'worst': least(s.worst, s.wealth * g.wealth / greatest(s.peak, s.wealth * g.wealth) - 1)}}).worst"
    start = "named_struct('wealth', 1.0D, 'peak', CAST(NULL AS DOUBLE), 'worst', CAST(NULL AS DOUBLE))"
    step = "named_struct('wealth', s.wealth * g, 'peak', greatest(s.peak, s.wealth * g), 'worst', least(s.worst, s.wealth * g / greatest(s.peak, s.wealth * g) - 1))"
    return f"aggregate({grown}, {start}, (s, g) -> {step}).worst"


@operator
def downside_deviation(p, data, window, axis=0):
    return p.let(_full(f"stddev_samp(CASE WHEN {data} < 0 THEN {data} END)", window, axis))


@operator
def sharpe_ratio(p, data, window, periods_per_year=252, axis=0):
    return p.let(f"{ratio(moving_average(p, data, window, axis), ts_std(p, data, window, axis))} * {math.sqrt(periods_per_year)!r}")


@operator
def sortino_ratio(p, data, window, periods_per_year=252, axis=0):
    return p.let(f"{ratio(moving_average(p, data, window, axis), downside_deviation(p, data, window, axis))} * {math.sqrt(periods_per_year)!r}")


@operator
def calmar_ratio(p, data, window, periods_per_year=252, axis=0):
    return p.let(ratio(f"{moving_average(p, data, window, axis)} * {periods_per_year}", f"abs({rolling_max_drawdown(p, data, window, axis)})"))


@operator
def alpha(p, data, benchmark_data, window, axis=0):
    return _pairs(p, "regr_intercept({x}, {y})", data, benchmark_data, window, axis)


@operator
def beta(p, data, benchmark_data, window, axis=0):
    return _pairs(p, "regr_slope({x}, {y})", data, benchmark_data, window, axis)


@operator
def neutralize(p, factor_data, risk_factors_data, axis=1):
    g = f"OVER ({_group(axis)})"
    x, y = p.let(f"CASE WHEN {factor_data} IS NOT NULL THEN {risk_factors_data} END"), p.let(f"CASE WHEN {risk_factors_data} IS NOT NULL THEN {factor_data} END")
    slope, level = p.let(finite(f"regr_slope({y}, {x}) {g}")), p.let(finite(f"regr_intercept({y}, {x}) {g}"))
    return p.let(f"{y} - ({level} + {slope} * {x})")


@operator
def winsorize(p, data, lower_percentile=0.01, upper_percentile=0.99, axis=None):
    if axis is None:  # percentiles of the whole array
        lo, hi = (p.let(lambda d, q=q: d.pct(data, q), "whole") for q in (lower_percentile, upper_percentile))
    else:
        lo, hi = (p.let(lambda d, q=q: f"{d.pct(data, q)} OVER ({_group(axis)})") for q in (lower_percentile, upper_percentile))
    return clip(p, data, lo, hi)


@operator
def clip(p, data, lower_bound=None, upper_bound=None):
    x = data
    if upper_bound is not None:
        x = f"least({x}, {upper_bound})"
    if lower_bound is not None:
        x = f"greatest({x}, {lower_bound})"
    return p.let(f"CASE WHEN {data} IS NOT NULL THEN {x} END")


@operator
def fill_na(p, data, method="ffill", value=None, axis=0):
    order = _order(axis or 0)
    if method == "ffill":
        return p.let(lambda d: d.last(data, so_far(order)))
    if method == "bfill":
        return p.let(lambda d: d.first(data, f"{order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"))
    if method == "zero":
        return p.let(f"coalesce({data}, 0e0)")
    if method == "value":
        return p.let(f"coalesce({data}, {float(value)!r})")
    if method in ("mean", "median"):
        return p.let(f"coalesce({data}, {(mean if method == 'mean' else median)(p, data, axis or 0)})")
    raise ValueError(f"unknown method {method}")


@operator
def cross_sectional_rank(p, data, axis=1):
    by, along = (DATE, KEY) if axis == 1 else (KEY, DATE)
    n = f"count({data}) OVER (PARTITION BY {by})"
    place = f"row_number() OVER (PARTITION BY {by} ORDER BY {data} ASC NULLS LAST, {along})"
    return p.let(f"CASE WHEN {data} IS NULL THEN NULL WHEN {n} > 1 THEN ({place} - 1e0) / ({n} - 1) ELSE 0e0 END")


@operator
def cross_sectional_scale(p, data, axis=1):
    g = f"OVER ({_group(axis)})"
    return p.let(ratio(f"{data} - avg({data}) {g}", f"stddev_pop({data}) {g}"))
