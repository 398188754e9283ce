"""Rolling technical indicators over the dense panel.

Means need a full window of rows, whatever of them is null; deviations, sums,
minima and maxima take partial windows.  An indicator is a column of a staged
plan; all windows of all indicators share one exchange by code and one sort.
Exponential averages and the stochastic lines carry state from row to row, so
they run over Arrow batches, a code's history at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barsmith.functions.decay import decay
from barsmith.functions.dialect import BY_CODE, DATE, KEY, ratio, rows, so_far
from barsmith.plans.staged import Stage, apply, needed

#: Windows of the default catalogue.
WINDOWS = (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 15, 19, 20, 22, 25, 26, 30, 35, 60, 99)
#: Indicators that take no window.
UNWINDOWED = ("OBV", "PVT", "TR")
RECURSIVE = ("EMA", "EMADiff", "TRIX", "MATRIX-3", "MATRIXDiff-3", "MATRIX-5", "MATRIXDiff-5", "KDJ-K-3", "KDJ-D-3", "KDJ-J-3", "KDJ-KD-3", "KDJ-KJ-3", "KDJ-DJ-3")


def column(metric: str) -> str:
    """A metric's column name in a plan."""
    return metric.replace("-", "_")


def mean(x: str, n: int) -> str:
    return f"CASE WHEN row_no >= {n} THEN avg({x}) OVER ({rows(n)}) END"


def total(x: str, n: int) -> str:
    return f"sum({x}) OVER ({rows(n)})"


def deviation(x: str, n: int) -> str:
    """Sample deviation, 0 of a single value."""
    return f"CASE WHEN count({x}) OVER ({rows(n)}) > 0 THEN coalesce(stddev_samp({x}) OVER ({rows(n)}), 0) END"


def _positive(x: str) -> str:
    """max(0, x), null where x is."""
    return f"CASE WHEN {x} > 0 THEN {x} WHEN {x} <= 0 THEN 0e0 END"


def stages(w: int) -> list[Stage]:
    """All windowed indicators without state, for one window."""
    back = lambda x, n: f"lag({x}, {n}) OVER ({BY_CODE})"
    out: list[Stage] = [
        {"row_no": f"row_number() OVER ({BY_CODE})", "prev_close": back("close", 1), "prev_high": back("high", 1), "prev_low": back("low", 1), "then_close": back("close", w)},
        {
            "move": "close - prev_close",
            "typical": "(high + low + close) / 3",
            "base_price": "(3 * close + high + low + open) / 6",
            "prev_mid": "(prev_high + prev_low) / 2",
            "TR": "greatest(high - low, abs(high - prev_close), abs(low - prev_close))",
            "high_move": "high - prev_high",
            "low_move": "prev_low - low",
            "MTM": "close - then_close",
        },
        {
            "gain": "CASE WHEN move > 0 THEN move ELSE 0e0 END",
            "loss": "CASE WHEN move < 0 THEN - move ELSE 0e0 END",
            "up_day": "CASE WHEN move > 0 THEN 1e0 ELSE 0e0 END",
            "obv_step": "CASE WHEN row_no = 1 THEN 0e0 * vol ELSE sign(move) * vol END",
            "pvt_step": "CASE WHEN row_no > 1 THEN coalesce(move / nullif(prev_close, 0), 0e0) * vol ELSE 0e0 END",
            "cr_up": _positive("(high - prev_mid)"),
            "cr_down": _positive("(prev_mid - low)"),
            "br_up": _positive("(high - prev_close)"),
            "br_down": _positive("(prev_close - low)"),
            "vol_up": "CASE WHEN vol IS NULL THEN NULL WHEN move > 0 THEN vol ELSE 0e0 END",
            "vol_down": "CASE WHEN vol IS NULL THEN NULL WHEN move < 0 THEN vol ELSE 0e0 END",
            "vol_even": "CASE WHEN vol IS NULL THEN NULL WHEN move = 0 THEN vol ELSE 0e0 END",
            "plus_dm": "CASE WHEN high_move > low_move AND high_move > 0 THEN high_move ELSE 0e0 END",
            "minus_dm": "CASE WHEN low_move > high_move AND low_move > 0 THEN low_move ELSE 0e0 END",
        },
        {
            "CloseMA": mean("close", w),
            "PriceSigma": deviation("close", w),
            "L": f"min(low) OVER ({rows(w)})",
            "H": f"max(high) OVER ({rows(w)})",
            "VolMA": mean("vol", w),
            "avg_gain": mean("gain", w),
            "avg_loss": mean("loss", w),
            "OBV": f"coalesce(sum(obv_step) OVER ({so_far()}), 0e0)",
            "PVT": f"coalesce(sum(pvt_step) OVER ({so_far()}), 0e0)",
            "PSY": f"{total('up_day', w)} / {w} * 100",
            "typical_ma": mean("typical", w),
            "CR": f"{ratio(total('cr_up', w), total('cr_down', w))} * 100",
            "vr_even": f"0.5 * {total('vol_even', w)}",
            "vr_up": total("vol_up", w),
            "vr_down": total("vol_down", w),
            "AR": f"{ratio(total('high - open', w), total('open - low', w))} * 100",
            "BR": f"{ratio(total('br_up', w), total('br_down', w))} * 100",
            "PDI": f"{ratio(total('plus_dm', w), total('TR', w))} * 100",
            "MDI": f"{ratio(total('minus_dm', w), total('TR', w))} * 100",
            "DKX": "CASE WHEN row_no >= 20 THEN (" + " + ".join(f"coalesce(lag(base_price, {i}) OVER ({BY_CODE}) * {20 - i}, 0)" if i else "coalesce(base_price * 20, 0)" for i in range(20)) + ") / 210 END",
        },
        {
            "CloseMADiff": "CloseMA - close",
            **{f"BollUp_{k}": f"CloseMA + {k} * PriceSigma" for k in (2, 3)},
            **{f"BollDo_{k}": f"CloseMA - {k} * PriceSigma" for k in (2, 3)},
            "RSV": "CASE WHEN H = L THEN 50e0 ELSE (close - L) / nullif(H - L, 0) * 100 END",
            "VolMADiff": "VolMA - vol",
            "RSI": "100 - 100 / (1 + avg_gain / CASE WHEN avg_loss = 0 THEN 1e-10 ELSE avg_loss END)",
            "MAOBV": mean("OBV", w),
            "MAPVT": mean("PVT", w),
            **{f"MTMMA_{s}": mean("MTM", s) for s in (3, 6, 10)},
            **{f"MAPSY_{s}": mean("PSY", s) for s in (3, 6)},
            "cci_off": "abs(typical - typical_ma)",
            **{f"macr_{n}": mean("CR", n) for n in (10, 20, 40, 62)},
            "VR": ratio("vr_up + vr_even", "vr_down + vr_even") + " * 100",
            "BRARDiff": "BR - AR",
            **{f"ARDiff_{n}": f"AR - {n}" for n in (40, 180)},
            **{f"BRDiff_{n}": f"BR - {n}" for n in (400, 40)},
            "BIAS": f"{ratio('close - CloseMA', 'CloseMA')} * 100",
            "PDIMDIDiff": "PDI - MDI",
            "directional": f"{ratio('abs(PDI - MDI)', 'PDI + MDI')} * 100",
            "DKXDiff": "DKX - close",
            **{f"MADKX_{n}": mean("DKX", n) for n in (5, 10, 15)},
        },
        {
            **{f"BollUpDiff_{k}": f"BollUp_{k} - close" for k in (2, 3)},
            **{f"BollDoDiff_{k}": f"BollDo_{k} - close" for k in (2, 3)},
            **{f"BollUpDo_{k}": f"BollUp_{k} - BollDo_{k}" for k in (2, 3)},
            "MAOBVDiff": "MAOBV - OBV",
            "MAPVTDiff": "MAPVT - PVT",
            **{f"MTMMADiff_{s}": f"MTMMA_{s} - MTM" for s in (3, 6, 10)},
            **{f"MAPSYDiff_{s}": f"MAPSY_{s} - PSY" for s in (3, 6)},
            "cci_md": mean("cci_off", w),
            **{f"MACR_{n}_{m}": back(f"macr_{n}", m) for n, m in ((10, 5), (20, 9), (40, 17), (62, 28))},
            **{f"MAVR_{n}": mean("VR", n) for n in (3, 6, 12)},
            **{f"MABIAS_{n}": mean("BIAS", n) for n in (5, 10)},
            "ADX_6": mean("directional", 6),
            **{f"MADKXDiff_{n}": f"MADKX_{n} - DKX" for n in (5, 10, 15)},
        },
        {
            "CCI": ratio("typical - typical_ma", "0.015 * cci_md"),
            **{f"MACRDiff_{n}_{m}": f"MACR_{n}_{m} - CR" for n, m in ((10, 5), (20, 9), (40, 17), (62, 28))},
            **{f"MAVRDiff_{n}": f"MAVR_{n} - VR" for n in (3, 6, 12)},
            **{f"MABIASDiff_{n}": f"MABIAS_{n} - BIAS" for n in (5, 10)},
            **{f"ADXR_6_{n}": f"(ADX_6 + {back('ADX_6', n)}) / 2" for n in (6, 14)},
        },
        {f"ADXRDiff_6_{n}": f"ADXR_6_{n} - ADX_6" for n in (6, 14)},
    ]
    return out


_HELPERS = {"row_no", "prev_close", "prev_high", "prev_low", "then_close", "move", "typical", "base_price", "prev_mid", "high_move", "low_move", "gain", "loss", "up_day", "obv_step", "pvt_step", "cr_up", "cr_down", "br_up", "br_down", "vol_up", "vol_down", "vol_even", "plus_dm", "minus_dm", "avg_gain", "avg_loss", "typical_ma", "vr_even", "vr_up", "vr_down", "cci_off", "cci_md", "directional", *(f"macr_{n}" for n in (10, 20, 40, 62))}
#: Every indicator that needs no state, as column names.
PLAIN = tuple(n for stage in stages(5) for n in stage if n not in _HELPERS)


def windowed(metrics: Iterable[str], windows: Iterable[int]) -> list[Stage]:
    """Stages of plain indicators of several windows in one plan: metric_window columns."""
    out: list[Stage] = []
    for w in windows:
        own = needed(stages(w), metrics)
        names = {n for stage in own for n in stage}
        for i, stage in enumerate(own):
            if i == len(out):
                out.append({})
            out[i] |= {f"{n}_{w}": re.sub(r"\w+", lambda m, w=w, names=names: f"{m[0]}_{w}" if m[0] in names else m[0], e) for n, e in stage.items()}
    return out


def wide(panel: DataFrame, metrics: Iterable[str], windows: Iterable[int] = WINDOWS) -> DataFrame:
    """(ts_code, trade_date, metric_window columns): all windows are frames of one exchange and sort by code;
    metrics with state add one pass a window."""
    names, windows = [column(m) for m in metrics], list(windows)
    plain = [n for n in names if n in PLAIN]
    out = apply(panel, windowed(plain, windows)).select(*panel.columns, *(f"{n}_{w}" for w in windows for n in plain))
    state = [n for n in names if n not in PLAIN]
    for w in windows if state else ():
        more = with_state(out, w)
        out = more.select(*out.columns, *(more[n].alias(f"{n}_{w}") for n in state))
    return out.select(KEY, DATE, *(f"{n}_{w}" for w in windows for n in names))


def indicators(panel: DataFrame, metrics: Iterable[str], window: int) -> DataFrame:
    """panel with the columns of some indicators for one window."""
    names = [column(m) for m in metrics]
    if any(m in {column(r) for r in RECURSIVE} for m in names):
        panel = with_state(panel, window)
    plain = [n for n in names if n in PLAIN]
    out = apply(panel, needed(stages(window), plain))
    return out.select(*panel.columns[: len(panel.columns)], *(n for n in plain if n not in panel.columns))


def _spread(known: np.ndarray, values: np.ndarray, before: float) -> np.ndarray:
    """One value for each known row, repeated over the rows that follow; `before` ahead of the first."""
    return np.concatenate([[before], values])[np.cumsum(known)]


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential average that starts at the first value and stands still over gaps."""
    known = ~np.isnan(x)
    some = x[known]
    return _spread(known, decay(some, 2 / (span + 1), some[0]) if len(some) else some, np.nan)


def _lines(rsv: np.ndarray, m: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The K and D lines, 50 on the first row; a missing RSV repeats them."""
    known = np.isfinite(rsv)
    known[:1] = False
    k = decay(rsv[known], 1 / m, 50e0)
    return _spread(known, k, 50e0), _spread(known, decay(k, 1 / m, 50e0), 50e0)


def with_state(panel: DataFrame, window: int) -> DataFrame:
    """panel with EMA, TRIX and the stochastic lines of one window and what follows from them.

    Only what the lines need passes through Arrow, a code's history at a time; the windows before and after
    and this grouping share one exchange by code."""
    base = apply(panel, needed(stages(window), ["RSV", "row_no"])).select(*panel.columns, "RSV", "row_no")
    names = ("EMA", "TRIX", "KDJ_K_3", "KDJ_D_3")

    def each(t: pa.Table) -> pa.Table:
        t = t.sort_by(DATE)
        one = ema(t.column("close").to_numpy().astype(float), window)
        three = ema(ema(one, window), window)
        prev = np.concatenate([[np.nan], three[:-1]])
        with np.errstate(all="ignore"):
            trix = (three - prev) / np.where(prev == 0, np.nan, prev) * 100
        lines = _lines(t.column("RSV").to_numpy().astype(float))
        for name, x in zip(names, (one, trix, *lines)):
            t = t.append_column(name, pa.array(x, pa.float64(), mask=np.isnan(x)))
        return t

    kinds = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
    out = base.groupBy(KEY).applyInArrow(each, f"{kinds}, " + ", ".join(f"{n} double" for n in names))
    return apply(out.select(*panel.columns, "row_no", *names), state_stages()).drop("row_no")


def state_stages() -> list[Stage]:
    return [
        {"EMADiff": "EMA - close", **{f"MATRIX_{n}": mean("TRIX", n) for n in (3, 5)}, "KDJ_J_3": "3 * KDJ_K_3 - 2 * KDJ_D_3", "KDJ_KD_3": "KDJ_K_3 - KDJ_D_3"},
        {**{f"MATRIXDiff_{n}": f"MATRIX_{n} - TRIX" for n in (3, 5)}, "KDJ_KJ_3": "KDJ_K_3 - KDJ_J_3", "KDJ_DJ_3": "KDJ_D_3 - KDJ_J_3"},
    ]


def long_table(panel: DataFrame, metrics: Iterable[str], windows: Iterable[int] = WINDOWS) -> DataFrame:
    """(ts_code, trade_date, metric, window, value) for indicators of many windows, nulls left out."""
    metrics, windows = list(metrics), list(windows)
    pairs = ", ".join(f"'{m}', {w}, cast({column(m)}_{w} as double)" for m in metrics for w in windows)
    return wide(panel, metrics, windows).selectExpr(KEY, DATE, f"stack({len(metrics) * len(windows)}, {pairs}) as (metric, window, value)").where("value is not null")


def wide_table(long: DataFrame) -> DataFrame:
    """One column metric:window for each pair of a long table."""
    return long.groupBy(KEY, DATE).pivot("name").agg({"value": "first"}) if "name" in long.columns else wide_table(long.selectExpr(KEY, DATE, "concat(metric, ':', window) as name", "value"))
