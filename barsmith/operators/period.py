"""Period metrics: risk and return of the window that ends on each date.

A period is so many trading days ("20d") or a calendar span ("5m", "1y", "2w"),
the half-open interval (start, end].  Rows are dealt by code once, for all periods
together.  A window is a span of its code's history, whose numbers are looked up
in prefix sums, tables of extremes, a tree of ranks and chains of highs, so its
length does not matter, and the metrics are arrays of formulas over them.  The SQL
that checks the metrics lays windows out by a join and has formulas of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barsmith.functions.dialect import DATE, KEY, Duck, Spark, ratio
from barsmith.functions.histories import Groups, numbered, whole_groups
from barsmith.functions.spans import Drawdowns, Series, plain_falls, plain_line, plain_moments, prefix, significant_digits
from barsmith.plans.staged import Stage, apply, significant

#: Yearly risk-free rate, and days a year for returns and for volatility.
RISK_FREE, RETURN_DAYS, TRADING_DAYS = 0.015, 365, 252
DAILY_RATE = math.log(1 + ((1 + RISK_FREE) ** (1 / RETURN_DAYS) - 1))
YEARLY_RATE = math.log(1 + RISK_FREE)
#: Periods of the default catalogue.
PERIODS = ("2d", "3d", "5d", "10d", "15d", "20d", "25d", "50d", "75d", "5m", "6m", "1y", "2y")
END = "end_date"
_GROUP = f"PARTITION BY {KEY}, {END}"
_ALONG = f"{_GROUP} ORDER BY {DATE}"
_SO_FAR = f"{_ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BEFORE = f"{_ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def parse(period: str) -> tuple[str, int]:
    n, unit = int(period[:-1]), period[-1]
    return ("d", n) if unit == "d" else ("w", n) if unit == "w" else ("m", n * (12 if unit == "y" else 1))


def start_of(period: str, end: str, dialect) -> str:
    """First day of a calendar period, not part of it."""
    if period in ("mtd", "qtd", "ytd"):
        unit = {"mtd": "month", "qtd": "quarter", "ytd": "year"}[period]
        return dialect.minus_days(f"CAST(date_trunc('{unit}', {end}) AS DATE)", 1)
    unit, n = parse(period)
    return dialect.minus_days(end, 7 * n) if unit == "w" else dialect.months(end, -n)


#: Days of a window of each share that percentiles are taken at, of all, positive and negative returns.
_SHARES, _TAILS = (0.5, 0.01, 0.05, 0.1, 0.9, 0.95, 0.99), (0.9, 0.95)
_COLUMNS = ("r", "close", "high", "low", "vol")
#: Share of a sum of squares below which what differences of prefix sums leave of it is too short of digits.
WEAK = 1e-3


def _calendar(period: str) -> bool:
    return period in ("mtd", "qtd", "ytd") or parse(period)[0] != "d"


def framed(panel: DataFrame, periods: Iterable[str]) -> DataFrame:
    """panel rows, each code's together and by date, with their number in it and the first day of each calendar period
    that ends on them (trading days are counted later)."""
    starts = (f"{start_of(p, DATE, Spark)} AS start_{p}" for p in periods if _calendar(p))
    return panel.selectExpr(KEY, DATE, numbered(), "log_return AS r", "close", "high", "low", "vol", *starts)


class Codes(Groups):
    """Whole histories of some codes, one after the other."""

    def __init__(self, t: pa.Table):
        super().__init__(t)
        self.day = self.days(DATE)
        self.columns = {c: self.values(c) for c in _COLUMNS}
        known = np.where(np.isnan(self.columns["r"]), len(self), np.arange(len(self)))
        self.known = np.minimum.reduceat(known, self.first)

    def spans(self, period: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, days) of the eligible windows: rows [lo, hi), and calendar days from the start to the end.

        A window is eligible if it starts on or after its code's first row, and some return is known by then."""
        if _calendar(period):
            ends, start = np.arange(len(self)), self.days(f"start_{period}")
        else:
            n = parse(period)[1]
            ends = np.flatnonzero(self.no > n)
            start = self.day[ends - n]
        code = self.code[ends]
        at = self.known[code]
        fits = (start >= self.day[self.first][code]) & (at < len(self)) & (self.day[np.minimum(at, len(self) - 1)] <= start)
        ends, start = ends[fits], start[fits]
        return self.since(ends, start), ends + 1, self.day[ends] - start


def _runs(r: np.ndarray, k: int):
    """A function of spans that counts how often gains and losses of blocks of k rows follow each other in them.

    Blocks are counted from a span's first row, so there are k ways to cut the history; in each, counts of
    neighbours add up, and a span's first known block has none before it."""
    if k == 1:
        x = r[~np.isnan(r)][:, None]
        seen = np.concatenate([[0], np.cumsum(~np.isnan(r))])
    else:
        rows = max(len(r) // k, 0) + 1
        x = np.full((rows, k), np.nan)
        if len(r) >= k:
            parts = np.lib.stride_tricks.sliding_window_view(r, k)
            sums = np.where(np.isnan(parts).all(axis=1), np.nan, np.nansum(parts, axis=1))
            x.ravel()[: len(sums)] = sums
    m = len(x)
    known = ~np.isnan(x)
    at = np.maximum.accumulate(np.where(known, np.arange(m)[:, None], -1), axis=0)
    before = np.concatenate([np.full((1, x.shape[1]), -1), at[:-1]]) if m else at
    was = np.where(before >= 0, np.take_along_axis(x, np.maximum(before, 0), axis=0), np.nan) if m else x
    first = np.concatenate([np.minimum.accumulate(np.where(known, np.arange(m)[:, None], m)[::-1], axis=0)[::-1], np.full((1, x.shape[1]), m)])
    pairs = {"ww": (was >= 0) & (x >= 0), "ll": (was < 0) & (x < 0), "wl": (was >= 0) & (x < 0), "lw": (was < 0) & (x >= 0)}
    sums = {n: np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(v, axis=0)]) for n, v in pairs.items()}

    def count(lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        row, column, end = (seen[lo], 0, seen[hi]) if k == 1 else (lo // k, lo % k, lo // k + (hi - lo) // k)
        begin = np.minimum(first[row, column] + 1, end)
        return {f"{n}{k}": s[end, column] - s[begin, column] for n, s in sums.items()}

    return count


class History:
    """Rows of whole codes: what all their windows of all periods look up.

    Volumes and closes are measured by their code's largest one, and returns add up from a code's first row on, so
    that codes of any size can stand side by side."""

    def __init__(self, codes: Codes):
        r, close, high, low, vol = (codes.columns[c] for c in _COLUMNS)
        self.unit = codes.scale(vol)
        self.r, self.high, self.low, self.vol = map(Series, (r, high, low, vol / self.unit))
        self.plain, self.close = close, Series(close / np.exp2(np.ceil(np.log2(codes.scale(close)))))  # a power of two costs no digit
        self.size = np.full(len(codes), (self.r.values**2).mean() if len(self.r.values) else 0.0)
        self.pos, self.neg = Series(np.where(r > 0, r, np.nan)), Series(np.where(r < 0, -r, np.nan))
        self.poor = Series(np.where(r < DAILY_RATE, r, np.nan))
        self.under, self.over = Series(np.where(r < DAILY_RATE, r - DAILY_RATE, 0.0)), Series(np.where(r > 0, r, 0.0))
        run = np.cumsum(np.where(self.r.known, r, 0))
        self.run = Series(np.where(self.r.known, run - run[codes.first][codes.code], np.nan))
        with np.errstate(all="ignore"):
            self.log_close = Series(np.where(close > 0, np.log(close), np.nan))
        # plain sums, so that nothing adds up to exactly 0
        some = lambda x: prefix(np.where(np.isnan(x), 0, x))
        self.sums = {"tot": some(r), "pos": some(self.pos.x), "neg": some(-self.neg.x), "gains": prefix(np.where(r > DAILY_RATE, r - DAILY_RATE, 0.0)), "losses": prefix(np.where(r < DAILY_RATE, DAILY_RATE - r, 0.0))}
        self.runs = [_runs(r, k) for k in (1, 5, 10)]
        self.falls = Drawdowns(self.close) if (self.close.values > 0).all() else None

    def _falls(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        if self.falls is not None:
            return self.falls.at(lo, hi)
        # prices of 0 and below have no order of falls: window by window
        out = {n: np.zeros(len(lo), np.int64 if n in ("mdd_row", "peak_row", "highs") else float) for n in ("mdd", "mdd_row", "peak_row", "dd2", "highs")}
        for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
            c = self.plain[a:b]
            peak = np.maximum.accumulate(np.where(np.isnan(c), -np.inf, c))
            with np.errstate(all="ignore"):
                dd = np.where(~np.isnan(c) & (peak != 0), c / peak - 1, 0.0)
            at = np.flatnonzero(dd == dd.min())[-1]
            top = np.flatnonzero(dd[: at + 1] >= 0)
            out["mdd"][i], out["mdd_row"][i], out["peak_row"][i], out["dd2"][i] = dd[at], a + at, a + top[-1] if len(top) else -1, (dd * dd).sum()
            out["highs"][i] = (c > np.concatenate([[-np.inf], peak[:-1]])).sum()
        return out

    def _mend(self, out: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> None:
        """Windows that are all but a line, or whose returns hardly differ, from their own rows: few in most histories."""
        with np.errstate(all="ignore"):
            weak = (out["n"] > 2) & ~(out["syy"] - out["sxy"] ** 2 / out["sxx"] > WEAK * out["syy"])
            flat = (out["n"] > 1) & ~self.r.constant(lo, hi) & ~(out["m2"] > WEAK * self.size[lo])
        if weak.any():
            for k, v in zip(("sxx", "syy", "sxy"), plain_line(self.r.x, lo[weak], hi[weak])):
                out[k][weak] = v
        if flat.any():
            made, n = plain_moments(self.r.x, lo[flat], hi[flat]), out["n"][flat]
            for k, v in zip(("m2", "m3", "m4"), made):
                out[k][flat] = v / n
            out["sd"][flat] = np.sqrt(made[0] / (n - 1))

    def numbers(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        """What ``aggregates`` says of each window."""
        r, rows = self.r, hi - lo
        n, mu = r.n(lo, hi), r.mean(lo, hi)
        some = np.maximum(n, 1)
        out = {"n_rows": rows, "n": n, "mu": mu, "sd": r.deviation(lo, hi, 1), "hi": r.maximum(lo, hi), "lo": r.minimum(lo, hi), "mad": r.spread(lo, hi, mu)}
        out |= {k: (s[hi] - s[lo]).astype(float) for k, s in self.sums.items()}
        out |= {"n_pos": self.pos.n(lo, hi), "n_neg": self.neg.n(lo, hi)}
        out |= {f"m{k}": np.where(n > 0, v / some, np.nan) for k, v in zip((2, 3, 4), r.central(lo, hi, 4))}
        falls = self._falls(lo, hi)
        out |= {"mdd": falls["mdd"], "mdd_idx": (falls["mdd_row"] - lo).astype(float), "peak_idx": np.where(falls["peak_row"] >= 0, falls["peak_row"] - lo, np.nan), "dd2": falls["dd2"] / np.maximum(rows, 1), "highs": falls["highs"]}
        out |= {"down": self.under.deviation(lo, hi, 1), "up": self.over.deviation(lo, hi, 1)}
        out |= {"pos_sd": self.pos.deviation(lo, hi, 0), "pos_mu": self.pos.mean(lo, hi), "neg_sd": self.neg.deviation(lo, hi, 0), "neg_mu": -self.neg.mean(lo, hi)}
        out["sxx"], out["syy"], out["sxy"] = self.run.regression(lo, hi)
        out["pxx"], out["pyy"], out["pxy"] = self.log_close.regression(lo, hi)
        self._mend(out, lo, hi)
        if self.falls is not None:
            near = (out["mdd"] < 0) & ~(out["dd2"] * self.close.minimum(lo, hi) ** 2 > WEAK)
            if near.any():
                out["dd2"][near] = plain_falls(self.plain, lo[near], hi[near]) / rows[near]
        n_low = self.poor.n(lo, hi)
        out["low3"] = np.where(n_low > 0, self.poor.central(lo, hi, 3)[1] / np.maximum(n_low, 1), np.nan)
        unit = self.unit[lo]
        out |= {"v_mu": self.vol.mean(lo, hi) * unit, "v_sd": self.vol.deviation(lo, hi, 1) * unit}
        out["vxx"], _, vxy = self.vol.regression(lo, hi)
        out["vxy"] = vxy * unit
        out |= {"max_high": self.high.maximum(lo, hi), "min_low": self.low.minimum(lo, hi), "avg_high": self.high.mean(lo, hi), "avg_low": self.low.mean(lo, hi), "n_close": self.close.n(lo, hi)}
        out |= dict(zip(("med", "q1", "q5", "q10", "q90", "q95", "q99"), r.quantiles(lo, hi, _SHARES)))
        out["win90"], out["win95"] = self.pos.quantiles(lo, hi, _TAILS)
        out["lose90"], out["lose95"] = self.neg.quantiles(lo, hi, _TAILS)
        for count in self.runs:
            out |= count(lo, hi)
        return out


#: Numbers of a window that count something.
_COUNTS = {"n_rows", "n", "n_pos", "n_neg", "n_close", "highs", *(f"{a}{k}" for a in ("ww", "ll", "wl", "lw") for k in (1, 5, 10))}


def _histories(panel: DataFrame, periods: list[str], names: list[str], numbers) -> DataFrame:
    """(ts_code, end_date, period, days, names): one exchange and one pass over each code for its windows of all periods.

    numbers(codes) gives a function of spans (lo, hi) and their days that returns the named arrays."""
    kinds = [(KEY, "string"), (END, "date"), ("period", "string"), ("days", "int"), *((n, "long" if n in _COUNTS else "double") for n in names)]

    def each(batches):
        for t in whole_groups(batches):
            codes = Codes(t)
            look = numbers(codes)
            for p in periods:
                lo, hi, days = codes.spans(p)
                if len(lo):
                    got, at = look(lo, hi, days), pa.array(hi - 1)
                    made = [codes.table.column(KEY).combine_chunks().take(at), codes.table.column(DATE).combine_chunks().take(at), pa.array([p] * len(lo), pa.string()), pa.array(days.astype(np.int32))]
                    made += [pa.array(got[n].astype(np.int64)) if n in _COUNTS else pa.array(got[n].astype(float), mask=np.isnan(got[n])) for n in names]
                    yield pa.RecordBatch.from_arrays(made, names=[n for n, _ in kinds])

    return framed(panel, periods).mapInArrow(each, ", ".join(f"{n} {k}" for n, k in kinds))


def _lookup(codes: Codes):
    history = History(codes)
    return lambda lo, hi, days: history.numbers(lo, hi)


def window_aggregates(panel: DataFrame, periods: Iterable[str]) -> DataFrame:
    """(ts_code, end_date, period, the columns of aggregates) of each eligible window of each period."""
    names = [n for n in aggregates() if n != "days"]
    return _histories(panel, list(periods), names, _lookup)


def members_sql(period: str) -> str:
    """The same rows as common table expressions over panel; the last is named members."""
    unit, n = ("m", 12) if period in ("mtd", "qtd", "ytd") else parse(period)
    start = f"lag({DATE}, {n}) OVER (PARTITION BY {KEY} ORDER BY {DATE})" if unit == "d" else start_of(period, DATE, Duck)
    return f"""ends AS (SELECT {KEY}, {DATE} AS {END}, {start} AS start, min(CASE WHEN log_return IS NOT NULL THEN {DATE} END) OVER (PARTITION BY {KEY}) AS first_day, min({DATE}) OVER (PARTITION BY {KEY}) AS first_row FROM panel),
members AS (SELECT e.{KEY}, e.{END}, (e.{END} - e.start)::INT AS natural_days, p.{DATE}, p.log_return AS r, p.close, p.high, p.low, p.vol
  FROM ends e JOIN panel p ON p.{KEY} = e.{KEY} AND p.{DATE} > e.start AND p.{DATE} <= e.{END} WHERE e.start >= e.first_row AND e.first_day <= e.start)"""


def row_stages() -> list[Stage]:
    """What a row needs to know of its window, in the SQL that checks the window matrices."""
    pair = lambda x: {f"was_{x}": lambda d, x=x: d.last(x, _BEFORE)}
    block = lambda n: f"CASE WHEN idx % {n} = {n - 1} THEN sum(r) OVER (PARTITION BY {KEY}, {END}, CAST(floor(idx / {n}) AS INT)) END"
    return [
        {"idx": f"row_number() OVER ({_ALONG}) - 1", "peak": f"max(close) OVER ({_SO_FAR})", "old_peak": f"max(close) OVER ({_BEFORE})", "run": f"CASE WHEN r IS NOT NULL THEN sum(r) OVER ({_SO_FAR}) END", "dev": f"r - avg(r) OVER ({_GROUP})", "low_r": f"CASE WHEN r < {DAILY_RATE!r} THEN r END"},
        {"dd": f"coalesce({ratio('close', 'peak')} - 1, 0e0)", "block5": block(5), "block10": block(10), "low_dev": f"low_r - avg(low_r) OVER ({_GROUP})"},
        {"worst": f"min(dd) OVER ({_GROUP})", **pair("r"), **pair("block5"), **pair("block10")},
        {"worst_idx": f"max(CASE WHEN dd = worst THEN idx END) OVER ({_GROUP})"},
    ]


def aggregates() -> Stage:
    when = lambda test, x="r": f"CASE WHEN {test} THEN {x} END"
    sums = lambda test, x="r": f"coalesce(sum({when(test, x)}), 0e0)"
    out: Stage = {
        "n_rows": "count(*)",
        "n": "count(r)",
        "days": "max(natural_days)",
        "tot": "coalesce(sum(r), 0e0)",
        "mu": "avg(r)",
        "sd": "stddev_samp(r)",
        "hi": "max(r)",
        "lo": "min(r)",
        "pos": sums("r > 0"),
        "neg": sums("r < 0"),
        "n_pos": f"count({when('r > 0')})",
        "n_neg": f"count({when('r < 0')})",
        "med": lambda d: d.pct("r", 0.5),
        "mad": "avg(abs(dev))",
        "m2": "avg(dev * dev)",
        "m3": "avg(dev * dev * dev)",
        "m4": "avg(dev * dev * dev * dev)",
        "mdd": "min(dd)",
        "mdd_idx": "max(worst_idx)",
        "peak_idx": f"max({when('dd >= 0 AND idx <= worst_idx', 'idx')})",
        "dd2": "avg(dd * dd)",
        "down": f"stddev_samp(CASE WHEN r < {DAILY_RATE!r} THEN r - {DAILY_RATE!r} ELSE 0e0 END)",
        "up": "stddev_samp(CASE WHEN r > 0 THEN r ELSE 0e0 END)",
        "pos_sd": f"stddev_pop({when('r > 0')})",
        "pos_mu": f"avg({when('r > 0')})",
        "neg_sd": f"stddev_pop({when('r < 0')})",
        "neg_mu": f"avg({when('r < 0')})",
        "gains": f"{sums(f'r > {DAILY_RATE!r}', f'(r - {DAILY_RATE!r})')}",
        "losses": f"{sums(f'r < {DAILY_RATE!r}', f'({DAILY_RATE!r} - r)')}",
        "sxx": "regr_sxx(run, idx)",
        "syy": "regr_syy(run, idx)",
        "sxy": "regr_sxy(run, idx)",
        "pxx": "regr_sxx(CASE WHEN close > 0 THEN ln(close) END, idx)",
        "pyy": "regr_syy(CASE WHEN close > 0 THEN ln(close) END, idx)",
        "pxy": "regr_sxy(CASE WHEN close > 0 THEN ln(close) END, idx)",
        "low3": "avg(low_dev * low_dev * low_dev)",
        "v_mu": "avg(vol)",
        "v_sd": "stddev_samp(vol)",
        "vxx": "regr_sxx(vol, idx)",
        "vxy": "regr_sxy(vol, idx)",
        "max_high": "max(high)",
        "min_low": "min(low)",
        "avg_high": "avg(high)",
        "avg_low": "avg(low)",
        "n_close": "count(close)",
        "highs": f"count({when('close IS NOT NULL AND (old_peak IS NULL OR close > old_peak)', '1')})",
    }
    for q in (1, 5, 10, 90, 95, 99):
        out[f"q{q}"] = lambda d, q=q: d.pct("r", q / 100)
    for q in (90, 95):
        out[f"win{q}"] = lambda d, q=q: d.pct("CASE WHEN r > 0 THEN r END", q / 100)
        out[f"lose{q}"] = lambda d, q=q: d.pct("CASE WHEN r < 0 THEN - r END", q / 100)
    for name, x in ((1, "r"), (5, "block5"), (10, "block10")):
        for a, b, label in ((">=", ">=", "ww"), ("<", "<", "ll"), (">=", "<", "wl"), ("<", ">=", "lw")):
            out[f"{label}{name}"] = f"count(CASE WHEN was_{x} {a} 0 AND {x} {b} 0 THEN 1 END)"
    return out


def _ratio0(a: str, b: str) -> str:
    return f"coalesce({ratio(a, b)}, 0e0)"


def result_stages() -> list[Stage]:
    z = {c: NormalDist().inv_cdf(1 - c / 100) for c in (99, 95, 90)}
    phi = lambda x: f"(exp(- ({x}) * ({x}) / 2) / sqrt(2 * pi()))"
    rf = f"({DAILY_RATE!r} * days)"
    mod = lambda v: f"({v!r} + ({v * v - 1!r}) * ReturnSkewness / 6 + ({v**3 - 3 * v!r}) * ReturnKurtosis / 24 - ({2 * v**3 - 5 * v!r}) * ReturnSkewness * ReturnSkewness / 36)"
    least0 = lambda x: f"CASE WHEN ({x}) > 0 THEN ({x}) WHEN ({x}) <= 0 THEN 0e0 END"
    first: Stage = {
        "TotalReturn": "tot",
        "AnnualizedReturn": f"tot / days * {RETURN_DAYS}",
        "AverageDailyReturn": "mu",
        "AvgPositiveReturn": "pos / n_rows",
        "AvgNegativeReturn": "neg / n_rows",
        "AvgReturnRatio": _ratio0("pos", "neg"),
        "TotalPositiveReturn": "pos",
        "TotalNegativeReturn": "neg",
        "TotalReturnRatio": _ratio0("pos", "abs(neg)"),
        "MedianDailyReturn": "med",
        "Volatility": "sd",
        "AnnualizedVolatility": f"sd * {math.sqrt(TRADING_DAYS)!r}",
        "MeanAbsoluteDeviation": "mad",
        "ReturnRange": "hi - lo",
        "RescaledRange": ratio("hi - lo", "sd"),
        "MaxGain": "hi",
        "MaxLoss": "lo",
        "MaxDrawDown": "mdd",
        "MaxDrawDownDays": "mdd_idx - peak_idx",
        "ReturnDrawDownRatio": _ratio0("exp(tot) - 1", "abs(mdd)"),
        # a yearly return beyond e^700 is no number
        "AnnReturnDrawDownRatio": f"CASE WHEN tot * {float(RETURN_DAYS)} / days < 700 THEN {ratio(f'exp(tot * {float(RETURN_DAYS)} / days) - 1', 'abs(mdd)')} END",
        "DrawDownSlope": _ratio0("abs(mdd)", "mdd_idx - peak_idx"),
        "UlcerIndex": "sqrt(dd2)",
        "SharpeRatio": _ratio0(f"tot - {rf}", "sd"),
        "ReturnVolatilityRatio": _ratio0("tot", "sd"),
        "DownsideVolatility": "down",
        "UpsideVolatility": "up",
        "VolatilitySkew": _ratio0("up - down", "sd"),
        "VolatilityRatio": _ratio0("up", "down"),
        "SortinoRatio": _ratio0(f"tot - {rf}", "down"),
        "GainConsistency": _ratio0("pos_sd", "pos_mu"),
        "LossConsistency": _ratio0("neg_sd", "abs(neg_mu)"),
        "WinningRatio": ratio("n_pos * 1e0", "n"),
        "LosingRatio": ratio("n_neg * 1e0", "n"),
        "ReturnSkewness": f"CASE WHEN n > 2 THEN {ratio('m3', 'power(m2, 1.5)')} * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) END",
        "ReturnKurtosis": f"CASE WHEN n > 3 THEN ((n + 1) * ({ratio('m4', 'm2 * m2')} - 3) + 6) * (n - 1) / (CAST(n - 2 AS DOUBLE) * (n - 3)) END",
        **{f"VaR_{c}": least0(f"- (mu + {z[c]!r} * sd)") for c in z},
        **{f"CVaR_{c}": least0(f"- (mu - sd * {NormalDist().pdf(z[c]) / (1 - c / 100)!r})") for c in z},
        **{f"Percentile_{q}": f"q{q}" for q in (1, 99, 5, 95, 10, 90)},
        **{f"PercentileWin_{q}": f"coalesce(win{q}, 0e0)" for q in (95, 90)},
        **{f"PercentileLoss_{q}": f"coalesce(lose{q}, 0e0)" for q in (95, 90)},
        **{f"TailRatio_{q}": f"coalesce(win{q}, 0e0) / greatest(coalesce(lose{q}, 0e0), 1e-6)" for q in (90, 95)},
        "NewHighRatio": "highs * 1e0 / greatest(n_close, 1)",
        **{f"CrossProductRatio_{k}": _ratio0(f"ww{k} * 1e0 * ll{k}", f"wl{k} * 1e0 * lw{k}") for k in (1, 5, 10)},
        "OmegaRatio": f"coalesce({ratio('gains', 'n')} / ({ratio('losses', 'n')} + 1e-8), 0e0)",
        "ReturnDistributionIntegral": ratio("gains", "n"),
        "ReturnSlope": ratio("sxy", "sxx"),
        "KRatio": f"CASE WHEN n > 2 AND syy - {ratio('sxy * sxy', 'sxx')} > 1e-18 THEN {ratio('sxy', 'sxx')} / (sqrt((syy - {ratio('sxy * sxy', 'sxx')}) / (n - 2)) / sqrt(sxx)) END",
        "SortinoSkewness": _ratio0("low3", "down * down * down"),
        "NetEquitySlope": ratio("pxy", "pxx"),
        "EquitySmoothness": ratio("pxy * pxy", "pxx * pyy"),
        "VolAvg": "v_mu",
        "VolSlope": ratio("vxy", "vxx"),
        "VolVolatility": "v_sd",
        "MaxHigh": "max_high",
        "MinLow": "min_low",
        "HLDiff": "max_high - min_low",
        "AvgHigh": "avg_high",
        "AvgLow": "avg_low",
    }
    second: Stage = {
        "MartinRatio": ratio("AnnualizedReturn", "UlcerIndex"),
        "AnnualizedSharpeRatio": _ratio0(f"AnnualizedReturn - {YEARLY_RATE!r}", "AnnualizedVolatility"),
        "VaRSharpe_95": _ratio0(f"tot - {rf}", "VaR_95"),
        "CVaRSharpe_95": _ratio0(f"tot - {rf}", "CVaR_95"),
        **{f"VaRModified_{c}": least0(f"- (mu + {mod(v)} * sd)") for c, v in z.items()},
        **{f"CVaRModified_{c}": least0(f"- (mu - sd * {phi(mod(v))} / {1 - c / 100!r})") for c, v in z.items()},
    }
    third: Stage = {"VaRModifiedSharpe_95": _ratio0(f"tot - {rf}", "VaRModified_95"), "CVaRModifiedSharpe_95": _ratio0(f"tot - {rf}", "CVaRModified_95")}
    return [first, second, third]


#: Every metric but the Hurst exponent, as column names.
METRICS = tuple(n for stage in result_stages() for n in stage)


def _over(a, b) -> np.ndarray:
    """a / b, NaN where b is 0 or unknown."""
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1, b))


def _or0(a, b) -> np.ndarray:
    return np.nan_to_num(_over(a, b), nan=0.0, posinf=np.inf, neginf=-np.inf)


def results(x: dict[str, np.ndarray], days: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of windows from their numbers; ``result_stages`` says the same in SQL."""
    x = {k: v.astype(float) for k, v in x.items()}
    n, tot, mu, sd, mdd, down = (x[k] for k in ("n", "tot", "mu", "sd", "mdd", "down"))
    known = lambda v: np.nan_to_num(v, nan=0.0)
    z = {c: NormalDist().inv_cdf(1 - c / 100) for c in (99, 95, 90)}
    excess, fall, fell = tot - DAILY_RATE * days, np.abs(mdd), x["mdd_idx"] - x["peak_idx"]
    year = tot / days * RETURN_DAYS
    out = {"TotalReturn": tot, "AnnualizedReturn": year, "AverageDailyReturn": mu, "AvgPositiveReturn": x["pos"] / x["n_rows"], "AvgNegativeReturn": x["neg"] / x["n_rows"]}
    out |= {"AvgReturnRatio": _or0(x["pos"], x["neg"]), "TotalPositiveReturn": x["pos"], "TotalNegativeReturn": x["neg"], "TotalReturnRatio": _or0(x["pos"], np.abs(x["neg"]))}
    out |= {"MedianDailyReturn": x["med"], "Volatility": sd, "AnnualizedVolatility": sd * math.sqrt(TRADING_DAYS), "MeanAbsoluteDeviation": x["mad"]}
    out |= {"ReturnRange": x["hi"] - x["lo"], "RescaledRange": _over(x["hi"] - x["lo"], sd), "MaxGain": x["hi"], "MaxLoss": x["lo"]}
    out |= {"MaxDrawDown": mdd, "MaxDrawDownDays": fell, "ReturnDrawDownRatio": _or0(np.expm1(tot), fall), "DrawDownSlope": _or0(fall, fell), "UlcerIndex": np.sqrt(x["dd2"])}
    out["AnnReturnDrawDownRatio"] = np.where(year < 700, _over(np.expm1(np.minimum(year, 700)), fall), np.nan)
    out |= {"SharpeRatio": _or0(excess, sd), "ReturnVolatilityRatio": _or0(tot, sd), "DownsideVolatility": down, "UpsideVolatility": x["up"]}
    out |= {"VolatilitySkew": _or0(x["up"] - down, sd), "VolatilityRatio": _or0(x["up"], down), "SortinoRatio": _or0(excess, down)}
    out |= {"GainConsistency": _or0(x["pos_sd"], x["pos_mu"]), "LossConsistency": _or0(x["neg_sd"], np.abs(x["neg_mu"])), "WinningRatio": _over(x["n_pos"], n), "LosingRatio": _over(x["n_neg"], n)}
    skew = np.where(n > 2, _over(x["m3"], x["m2"] ** 1.5) * np.sqrt(n * (n - 1)) / np.maximum(n - 2, 1), np.nan)
    kurt = np.where(n > 3, ((n + 1) * (_over(x["m4"], x["m2"] ** 2) - 3) + 6) * (n - 1) / np.maximum((n - 2) * (n - 3), 1), np.nan)
    out |= {"ReturnSkewness": skew, "ReturnKurtosis": kurt}
    for c, v in z.items():
        bent = v + (v * v - 1) * skew / 6 + (v**3 - 3 * v) * kurt / 24 - (2 * v**3 - 5 * v) * skew * skew / 36
        out |= {f"VaR_{c}": np.maximum(-(mu + v * sd), 0), f"CVaR_{c}": np.maximum(-(mu - sd * NormalDist().pdf(v) / (1 - c / 100)), 0)}
        density = np.exp(-bent * bent / 2) / math.sqrt(2 * math.pi)
        out |= {f"VaRModified_{c}": np.maximum(-(mu + bent * sd), 0), f"CVaRModified_{c}": np.maximum(-(mu - sd * density / (1 - c / 100)), 0)}
    out |= {f"Percentile_{q}": x[f"q{q}"] for q in (1, 99, 5, 95, 10, 90)}
    for q in (95, 90):
        win, lose = known(x[f"win{q}"]), known(x[f"lose{q}"])
        out |= {f"PercentileWin_{q}": win, f"PercentileLoss_{q}": lose, f"TailRatio_{q}": win / np.maximum(lose, 1e-6)}
    out["NewHighRatio"] = x["highs"] / np.maximum(x["n_close"], 1)
    out |= {f"CrossProductRatio_{k}": _or0(x[f"ww{k}"] * x[f"ll{k}"], x[f"wl{k}"] * x[f"lw{k}"]) for k in (1, 5, 10)}
    out |= {"OmegaRatio": known(_over(x["gains"], n) / (_over(x["losses"], n) + 1e-8)), "ReturnDistributionIntegral": _over(x["gains"], n), "ReturnSlope": _over(x["sxy"], x["sxx"])}
    rest = x["syy"] - _over(x["sxy"] ** 2, x["sxx"])
    out["KRatio"] = np.where((n > 2) & (rest > 1e-18), _over(x["sxy"], x["sxx"]) / (np.sqrt(np.maximum(rest, 1e-18) / np.maximum(n - 2, 1)) / np.sqrt(np.where(x["sxx"] > 0, x["sxx"], np.nan))), np.nan)
    out |= {"SortinoSkewness": _or0(x["low3"], down**3), "NetEquitySlope": _over(x["pxy"], x["pxx"]), "EquitySmoothness": _over(x["pxy"] ** 2, x["pxx"] * x["pyy"])}
    out |= {"VolAvg": x["v_mu"], "VolSlope": _over(x["vxy"], x["vxx"]), "VolVolatility": x["v_sd"]}
    out |= {"MaxHigh": x["max_high"], "MinLow": x["min_low"], "HLDiff": x["max_high"] - x["min_low"], "AvgHigh": x["avg_high"], "AvgLow": x["avg_low"]}
    out |= {"MartinRatio": _over(year, out["UlcerIndex"]), "AnnualizedSharpeRatio": _or0(year - YEARLY_RATE, out["AnnualizedVolatility"])}
    return out | {f"{v}Sharpe_95": _or0(excess, out[f"{v}_95"]) for v in ("VaR", "CVaR", "VaRModified", "CVaRModified")}


def period_catalogue(panel: DataFrame, periods: Iterable[str] = PERIODS, metrics: Iterable[str] = METRICS, digits: int | None = None) -> DataFrame:
    """(ts_code, end_date, period, metrics): null where a window has fewer than two returns; windows of one row are left out.

    digits rounds as ``staged.significant`` does."""
    metrics, periods = [m.replace("-", "_") for m in metrics], list(periods)
    if REGISTERED:
        made = window_aggregates(panel, periods).where("n_rows >= 2")
        out = apply(made, result_stages() + REGISTERED).selectExpr(KEY, END, "period", *(f"CASE WHEN n >= 2 THEN CAST({m} AS DOUBLE) END AS {m}" for m in metrics))
        return out if digits is None else out.selectExpr(KEY, END, "period", *(f"{significant(m, digits)} AS {m}" for m in metrics))

    def numbers(codes):
        history = History(codes)

        def look(lo, hi, days):
            got = history.numbers(lo, hi)
            with np.errstate(all="ignore"):
                made = results(got, days)
            made = {m: np.where(got["n"] >= 2, made[m], np.nan) for m in metrics}
            return {"n_rows": got["n_rows"], **(made if digits is None else {m: significant_digits(v, digits) for m, v in made.items()})}

        return look

    return _histories(panel, periods, ["n_rows", *metrics], numbers).where("n_rows >= 2").drop("days", "n_rows")


def period_metrics(panel: DataFrame, period: str, metrics: Iterable[str] = METRICS, digits: int | None = None) -> DataFrame:
    """(ts_code, end_date, metrics) of one period."""
    return period_catalogue(panel, [period], metrics, digits).drop("period")


#: Metrics that users add: expressions over the columns of ``aggregates`` and over other metrics.
REGISTERED: list[Stage] = []


def register_metric(name: str, expression: str) -> None:
    """Make an expression over a window's numbers and metrics available to period_metrics under a name."""
    if any(name in stage for stage in result_stages() + REGISTERED):
        raise ValueError(f"there is a metric {name} already")
    REGISTERED.append({name: expression})


def period_metrics_sql(base: str, period: str, metrics: Iterable[str] = METRICS) -> str:
    parts, prev = [base, members_sql(period)], "members"
    for i, s in enumerate(row_stages()):
        parts.append(f"pr{i} AS (SELECT *, {', '.join(f'{e(Duck) if callable(e) else e} AS {n}' for n, e in s.items())} FROM {prev})")
        prev = f"pr{i}"
    made = ", ".join(f"{e(Duck) if callable(e) else e} AS {n}" for n, e in aggregates().items())
    parts.append(f"pa AS (SELECT {KEY}, {END}, {made} FROM {prev} GROUP BY {KEY}, {END} HAVING count(*) >= 2)")
    prev = "pa"
    for i, s in enumerate(result_stages()):
        parts.append(f"pz{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in s.items())} FROM {prev})")
        prev = f"pz{i}"
    picked = ", ".join(f"{significant(f'(CASE WHEN n >= 2 THEN CAST({m} AS DOUBLE) END)')} AS {m}" for m in metrics)
    return f"WITH {', '.join(parts)} SELECT {KEY}, {END}, {picked} FROM {prev}"


def hurst(panel: DataFrame, period: str) -> DataFrame:
    """(ts_code, end_date, HurstExponent): slope of log rescaled range over six halvings; needs 64 returns."""

    def exponent(r: np.ndarray) -> float:
        r = r[~np.isnan(r)]
        if len(r) < 64:
            return np.nan
        sizes, ranges = [], []
        for level in range(6):
            size = len(r) >> level
            parts = r[: size << level].reshape(-1, size)
            parts = parts - parts.mean(axis=1, keepdims=True)
            spread = parts.std(axis=1)
            ranges.append(np.mean((parts.max(axis=1) - parts.min(axis=1)) / np.where(spread == 0, 1e-5, spread)))
            sizes.append(size)
        x, y = np.log10(sizes), np.log10(ranges)
        x = x - x.mean()
        return float((x * (y - y.mean())).sum() / max((x * x).sum(), 1e-5))

    def numbers(codes):
        r = codes.columns["r"]
        return lambda lo, hi, days: {"HurstExponent": np.array([exponent(r[a:b]) for a, b in zip(lo, hi)])}

    return _histories(panel, [period], ["HurstExponent"], numbers).drop("period", "days")
