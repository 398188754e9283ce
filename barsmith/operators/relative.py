"""Indicators that hold the present against a longer past, and long-short lines.

A *current* window ("5d": so many trading days, "5m", "1y": a calendar span) is
compared with a *history* window, a calendar span named by a metric's suffix.
Calendar windows are open at their start, as for period metrics.  All sums and
moments slide over window frames of one exchange and sort by code; a frame that
holds its start day as well drops that day's value from them, so no row of a
window is ever laid out.  The two percentiles are order statistics of a code's
history, some steps a bit of its length for each row.

A value is null until the history window lies within the code's returns, where a
window is too short for a deviation, and where a denominator is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barsmith.functions.dialect import BY_CODE, DATE, KEY, ratio, rows
from barsmith.functions.histories import Groups, along
from barsmith.functions.spans import Series
from barsmith.operators import rolling
from barsmith.operators.period import parse
from barsmith.plans.staged import Stage, apply, needed

BASES = ("ReturnZScore", "ReturnPercentile", "AverageDeviationReturn", "VolatilityRollingRatio", "VolatilityPercentile")
HISTORIES = ("2m", "6m", "1y", "2y")
METRICS = tuple(f"{b}_{h}" for b in BASES for h in HISTORIES)
#: Current windows of the default catalogue, by history.
CURRENT = {"2m": ("1d", "2d", "3d", "5d", "10d", "15d", "25d")}
CURRENT["6m"] = (*CURRENT["2m"], "50d", "75d")
CURRENT["1y"] = (*CURRENT["6m"], "5m", "6m")
CURRENT["2y"] = (*CURRENT["1y"], "1y")
#: Windows of the long-short lines.
TIES = 10  # decimals to which returns and deviations are the same in a percentile
BBI_MEANS, DMA_WINDOWS, MACD_SPANS, SLOPE_ROWS = (3, 6, 12, 24), (10, 50, 10), (12, 26, 9), 6


def _start(months: int) -> str:
    return f"add_months({DATE}, {-months})"


def _span(months: int) -> str:
    """All rows since a calendar span began, with the day that it began on."""
    return f"{BY_CODE} RANGE BETWEEN INTERVAL '{months}' MONTH PRECEDING AND CURRENT ROW"


def _first(x: str, months: int) -> str:
    """The value on the very day a span began, which is not part of it."""
    return f"CASE WHEN first_value({DATE}) OVER ({_span(months)}) = {_start(months)} THEN first_value({x}) OVER ({_span(months)}) END"


def moments(name: str, period: str) -> list[Stage]:
    """<name>_n, <name>_mean and <name>_std of the returns of a window, its sum <name>_sum."""
    unit, n = parse(period)
    if unit == "w":
        raise ValueError("current and history windows are days, months or years")
    if unit == "d":
        over = rows(n)
        first: Stage = {f"{name}_n": f"count(log_return) OVER ({over})", f"{name}_sum": f"sum(log_return) OVER ({over})", f"{name}_mean": f"avg(log_return) OVER ({over})", f"{name}_std": f"stddev_samp(log_return) OVER ({over})"}
        return [first]
    over = _span(n)
    return [
        {f"{name}_all": f"count(log_return) OVER ({over})", f"{name}_avg": f"avg(log_return) OVER ({over})", f"{name}_var": f"var_pop(log_return) OVER ({over})", f"{name}_out": _first("log_return", n)},
        {f"{name}_n": f"{name}_all - CASE WHEN {name}_out IS NULL THEN 0 ELSE 1 END"},
        {f"{name}_mean": f"CASE WHEN {name}_out IS NULL THEN {name}_avg ELSE ({name}_avg * {name}_all - {name}_out) / nullif({name}_n, 0) END"},
        # squares about the mean, less the part of the value that goes
        {f"{name}_std": f"CASE WHEN {name}_n > 1 THEN sqrt(greatest(0e0, {name}_var * {name}_all - CASE WHEN {name}_out IS NULL THEN 0e0 ELSE ({name}_out - {name}_avg) * ({name}_out - {name}_mean) END) / ({name}_n - 1)) END", f"{name}_sum": f"{name}_mean * {name}_n"},
    ]


def stages(current: str, history: str) -> list[Stage]:
    months = parse(history)[1]
    reach = f"min({DATE}) OVER (PARTITION BY {KEY})", f"min(CASE WHEN log_return IS NOT NULL THEN {DATE} END) OVER (PARTITION BY {KEY})"
    unit, n = parse(current)
    whole = f"row_number() OVER ({BY_CODE}) > {n}" if unit == "d" else f"{_start(n)} >= first_row"
    now, past = moments("now", current), moments("past", history)
    joined = [{**(now[i] if i < len(now) else {}), **(past[i] if i < len(past) else {})} for i in range(max(len(now), len(past)))]
    return [
        {"first_row": reach[0], "first_day": reach[1]},
        *joined,
        {"now_return": f"CASE WHEN {whole} AND now_n > 0 THEN round(now_sum, {TIES}) END", "now_level": f"CASE WHEN {whole} THEN now_mean END", "now_dev": f"CASE WHEN {whole} AND now_n > 1 THEN now_std END", "now_vol": f"CASE WHEN {whole} AND now_n > 1 THEN round(now_std, {TIES}) END", "known": f"{_start(months)} >= first_row AND first_day <= {_start(months)}"},
        {
            f"ReturnZScore_{history}": f"CASE WHEN known THEN {ratio('now_level - past_mean', 'past_std')} END",
            f"ReturnPercentile_{history}": f"CASE WHEN known THEN now_return_share END",
            f"AverageDeviationReturn_{history}": f"CASE WHEN known THEN {ratio('now_level - past_mean', 'past_mean')} END",
            f"VolatilityRollingRatio_{history}": f"CASE WHEN known THEN {ratio('now_dev', 'past_std')} END",
            f"VolatilityPercentile_{history}": f"CASE WHEN known THEN now_vol_share END",
        },
    ]


def _shares(groups: Groups, columns: list[str]) -> dict[str, np.ndarray]:
    """Share of the values since the history began that are not above the row's own, by order statistics of the code."""
    hi = np.arange(len(groups)) + 1
    lo = groups.since(hi - 1, groups.days("_since"))
    out = {}
    for c in columns:
        x = Series(groups.values(c))
        a, b = x.inner(lo, hi)
        count, _ = x.ranks.up_to(a, b, np.where(x.known, x.x, 0))
        out[f"{c}_share"] = np.where(x.known, count / np.maximum(b - a, 1), np.nan)
    return out


def relative_metrics(panel: DataFrame, current: str, history: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """(ts_code, trade_date, metrics): the current window of each date against one history."""
    names = list(metrics or (f"{b}_{history}" for b in BASES))
    *before, last = stages(current, history)
    last = {n: e for n, e in last.items() if n in names}
    words = set(re.findall(r"\w+", " ".join(last.values())))
    ranked = [c for c in ("now_return", "now_vol") if f"{c}_share" in words]
    out = apply(panel.select(KEY, DATE, "log_return"), needed(before, words | set(ranked)))
    if ranked:
        out = along(out.selectExpr("*", f"{_start(parse(history)[1])} AS _since"), [f"{c}_share" for c in ranked], lambda g: _shares(g, ranked))
    return apply(out, [last]).select(KEY, DATE, *names)


# --- long-short lines --------------------------------------------------------------------------------------------

LINES = ("BBI", "DMA", "DIF", "DEA", "MACD", "ADXSlop_6")


def line_stages(window: int = 14) -> list[Stage]:
    """BBI, DMA and ADXSlop_6: none of them carries state.  window: of the directional movement under ADX_6."""
    short, long, smooth = DMA_WINDOWS
    over = rows(SLOPE_ROWS)
    adx = needed(rolling.stages(window), ["ADX_6", "row_no"])
    return [
        *adx,
        {**{f"mean_{n}": rolling.mean("close", n) for n in {*BBI_MEANS, short, long}}, "slope_x": "CASE WHEN ADX_6 IS NOT NULL THEN CAST(row_no AS DOUBLE) END"},
        {"BBI": "(" + " + ".join(f"mean_{n}" for n in BBI_MEANS) + f") / {len(BBI_MEANS)}", "dma_gap": f"mean_{short} - mean_{long}"},
        {
            "DMA": f"CASE WHEN row_no >= {long + smooth - 1} THEN avg(dma_gap) OVER ({rows(smooth)}) END",
            "slope_top": f"covar_pop(ADX_6, slope_x) OVER ({over})",
            "slope_bottom": f"var_pop(slope_x) OVER ({over})",
            "slope_n": f"count(ADX_6) OVER ({over})",
        },
        {"ADXSlop_6": f"CASE WHEN slope_n = {SLOPE_ROWS} THEN {ratio('slope_top', 'slope_bottom')} END"},
    ]


def long_short_lines(panel: DataFrame, names: Iterable[str] = LINES, window: int = 14) -> DataFrame:
    """(ts_code, trade_date, lines).  DIF, DEA and MACD carry state and run over Arrow, a code's history at a time."""
    names, plain, state = list(names), ("BBI", "DMA", "ADXSlop_6"), ("DIF", "DEA", "MACD")
    out = panel
    if some := [n for n in names if n in plain]:
        out = apply(out, needed(line_stages(window), some)).select(*panel.columns, *some)
    if any(n in state for n in names):
        out = _macd(out.select(KEY, DATE, "close", *(n for n in names if n in plain)))
    return out.select(KEY, DATE, *names)


def _macd(rows_: DataFrame) -> DataFrame:
    short, long, signal = MACD_SPANS

    def each(t: pa.Table) -> pa.Table:
        t = t.sort_by(DATE)
        close = t.column("close").to_numpy().astype(float)
        dif = rolling.ema(close, short) - rolling.ema(close, long)
        dea = rolling.ema(dif, signal)
        for name, x in (("DIF", dif), ("DEA", dea), ("MACD", 2 * (dif - dea))):
            t = t.append_column(name, pa.array(x, pa.float64(), mask=np.isnan(x)))
        return t

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows_.dtypes)
    return rows_.groupBy(KEY).applyInArrow(each, f"{kinds}, DIF double, DEA double, MACD double")
