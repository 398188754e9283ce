"""Operators against plain NumPy and pandas on a small panel with gaps, ties and a constant code."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from barsmith.operators import factor, period, rolling
from barsmith.plans import evaluation, expression
from barsmith.functions.student import two_sided_p

N = 40


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(3)
    close = {c: np.round(50 + np.cumsum(rng.normal(size=N)), 2) for c in ("A", "B", "C")}
    close["D"] = np.full(N, 7.0)
    close["B"][[0, 5, 6, 20]] = np.nan
    close["C"][10] = close["C"][9]
    return pd.DataFrame(close, index=[date(2024, 1, 1) + timedelta(days=i) for i in range(N)])


@pytest.fixture(scope="module")
def panel(spark, wide):
    rng = np.random.default_rng(4)
    rows = []
    for c in wide:
        r = np.log(wide[c] / wide[c].shift(1))
        for i, d in enumerate(wide.index):
            v = float(wide[c].iloc[i])
            gap = v != v
            spread = float(abs(rng.normal()) + 0.1)
            rows.append((c, d, None if gap else v - 0.1, None if gap else v + spread, None if gap else v - spread, None if gap else v, None if gap else float(rng.integers(1, 9)), None if gap else 100.0, None if r.iloc[i] != r.iloc[i] else float(r.iloc[i])))
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, vol double, amount double, log_return double").cache()


def values(df, name):
    p = df.select("ts_code", "trade_date", name).toPandas()
    p["trade_date"] = p["trade_date"].map(lambda d: d if isinstance(d, date) else d.date())
    return p.pivot(index="trade_date", columns="ts_code", values=name).astype(float)


def roll(wide, w, f):
    out = wide * np.nan
    for c in wide:
        for i in range(w - 1, len(wide)):
            x = wide[c].iloc[i - w + 1 : i + 1].to_numpy()
            out.loc[wide.index[i], c] = f(x)
    return out


CASES = {
    "rolling_sum": lambda x: np.nansum(x),
    "rolling_max": lambda x: np.nanmax(x),
    "rolling_std": lambda x: np.nanstd(x),
    "moving_average": lambda x: np.nanmean(x),
    "rolling_product": lambda x: np.nanprod(x),
    "ts_rank": lambda x: np.nan if x[-1] != x[-1] else ((x < x[-1]).sum() + ((x == x[-1]).sum() - 1) / 2) / ((x == x).sum() - 1),
}


@pytest.mark.parametrize("name", CASES)
def test_window_operators(panel, wide, name):
    got = values(expression.factor_values(panel, {"func": name, "args": [{"var": "close"}, 5]}), "factor")
    pd.testing.assert_frame_equal(got, roll(wide, 5, CASES[name]), check_names=False, rtol=1e-9)


def test_moments(panel, wide):
    def skew(x):
        x = x[~np.isnan(x)]
        m = x - x.mean()
        return (m**3).mean() / (m**2).mean() ** 1.5 if len(x) > 2 and (m**2).mean() > 1e-14 else np.nan

    got = values(expression.factor_values(panel, {"func": "rolling_skew", "args": [{"var": "close"}, 6]}), "factor")
    pd.testing.assert_frame_equal(got, roll(wide, 6, skew), check_names=False, rtol=1e-6)


def clean(x, y=None):
    return x[~np.isnan(x)] if y is None else (lambda k: (x[k], y[k]))(~np.isnan(x) & ~np.isnan(y))


def _line(x, y):
    """Slope and level of x over y."""
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((y - y.mean()) ** 2).sum()
    return slope, x.mean() - slope * y.mean()


def _several(f, least=2):
    """f of the rows that both have, if there are enough and they vary."""

    def of(x, y):
        x, y = clean(x, y)
        return f(x, y) if len(x) >= least and np.ptp(x) > 0 and np.ptp(y) > 0 else np.nan

    return of


def _kurt(x):
    m = clean(x) - clean(x).mean()
    return (m**4).mean() / (m**2).mean() ** 2 - 3 if len(m) > 3 and (m**2).mean() > 1e-14 else np.nan


def _sd(x, ddof=1):
    return clean(x).std(ddof=ddof) if len(clean(x)) > ddof else np.nan


_R, _V = {"var": "log_return"}, {"var": "vol"}
TWINS = {
    "rolling_min": ([_R, 6], lambda x, y: clean(x).min()),
    "rolling_kurt": ([_R, 6], lambda x, y: _kurt(x)),
    "rolling_corr": ([_R, _V, 6], _several(lambda x, y: np.corrcoef(x, y)[0, 1])),
    "rolling_cov": ([_R, _V, 6], lambda x, y: np.cov(*clean(x, y))[0, 1] if len(clean(x, y)[0]) > 1 else np.nan),
    "beta": ([_R, _V, 6], _several(lambda x, y: _line(x, y)[0])),
    "alpha": ([_R, _V, 6], _several(lambda x, y: _line(x, y)[1])),
    "downside_deviation": ([_R, 6], lambda x, y: _sd(np.where(x < 0, x, np.nan))),
    "sharpe_ratio": ([_R, 6], lambda x, y: clean(x).mean() / _sd(x, 0) * np.sqrt(252) if _sd(x, 0) else np.nan),
    "sortino_ratio": ([_R, 6], lambda x, y: clean(x).mean() / _sd(np.where(x < 0, x, np.nan)) * np.sqrt(252)),
    "ts_delay": ([_R, 5], lambda x, y: x[0]),
    "ts_delta": ([_R, 5], lambda x, y: x[-1] - x[0]),
}


@pytest.mark.parametrize("name", TWINS)
def test_more_window_operators(panel, name):
    args, f = TWINS[name]
    got = values(expression.factor_values(panel, {"func": name, "args": args}), "factor")
    r, v = values(panel, "log_return"), values(panel, "vol")
    for c in "ABC":
        for i in range(5, len(r)):
            part = slice(i - 5, i + 1)
            with np.errstate(all="ignore"):
                want = f(r[c].iloc[part].to_numpy(), v[c].iloc[part].to_numpy())
            assert (np.isnan(want) and np.isnan(got[c].iloc[i])) or math.isclose(got[c].iloc[i], want, rel_tol=1e-7, abs_tol=1e-10), (c, i, got[c].iloc[i], want)


def test_series_that_stand_still(panel):
    """Correlations with a constant are null, not an error; a date whose values agree has no coefficient."""
    for tree in ({"func": "rolling_corr", "args": [_R, _V, 6]}, {"func": "correlation", "args": [_R, _V]}, {"func": "beta", "args": [_V, _R, 6]}):
        assert values(expression.factor_values(panel, tree), "factor")["D"].isna().all()
    same = panel.selectExpr("ts_code", "trade_date", "1e0 AS factor", "close AS forward")
    assert evaluation.daily_ic(same).count() == evaluation.daily_ic(same, True).count() == 0


def test_cross_section_operators(panel):
    r, v = values(panel, "log_return"), values(panel, "vol")
    rank = values(expression.factor_values(panel, {"func": "cross_sectional_rank", "args": [_R]}), "factor")
    scale = values(expression.factor_values(panel, {"func": "cross_sectional_scale", "args": [_R]}), "factor")
    rest = values(expression.factor_values(panel, {"func": "neutralize", "args": [_R, _V]}), "factor")
    for d in r.index[1:]:
        x = r.loc[d].dropna()
        order = {c: i for i, c in enumerate(sorted(x.index, key=lambda c: (x[c], c)))}
        np.testing.assert_allclose(rank.loc[d, x.index], [order[c] / max(len(x) - 1, 1) for c in x.index], rtol=1e-12)
        np.testing.assert_allclose(scale.loc[d, x.index], (x - x.mean()) / x.std(ddof=0), rtol=1e-9)
        y = v.loc[d, x.index]
        if len(x) > 2 and np.ptp(y) > 0:
            slope, level = _line(x, y)
            np.testing.assert_allclose(rest.loc[d, x.index], x - slope * y - level, atol=1e-10)


def test_drawdown_of_returns(panel):
    got = values(expression.factor_values(panel, {"func": "rolling_max_drawdown", "args": [{"var": "log_return"}, 6]}), "factor")
    r = values(panel, "log_return")

    def worst(x):
        cum = np.cumprod(1 + x[~np.isnan(x)])
        return (cum / np.maximum.accumulate(cum) - 1).min()

    pd.testing.assert_frame_equal(got, roll(r, 6, worst), check_names=False, rtol=1e-9)


def test_decay_keeps_its_state_over_gaps(panel, wide):
    got = values(expression.factor_values(panel, {"func": "exponential_moving_average", "args": {"data": {"var": "close"}, "span": 5}}), "factor")
    for c in wide:
        state, want = np.nan, []
        for v in wide[c]:
            if v == v:
                state = v if state != state else v / 3 + state * 2 / 3
            want.append(state if v == v else np.nan)
        np.testing.assert_allclose(got[c], want, rtol=1e-12)


def test_small_array_sum(spark):
    rows = [(c, date(2024, 1, i + 1), v) for i, line in enumerate([[1.0, 2.0, None], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]) for c, v in zip("abc", line)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, close double")
    got = values(expression.factor_values(df, {"func": "rolling_sum", "args": [{"var": "close"}, 2.0]}), "factor")
    np.testing.assert_array_equal(got.to_numpy(), [[np.nan] * 3, [5, 7, 6], [11, 13, 15]])


def test_all_operators_are_there():
    assert len(set(factor.OPERATORS) - {"ts_mean"}) == 52


def test_expressions_are_checked():
    for bad in ({"func": "nothing"}, {"func": "add", "args": [1]}, {"func": "add", "args": {"a": 1, "c": 2}}, {"func": "log", "args": [1, 2, 3]}):
        with pytest.raises(ValueError):
            expression.compile_factor(bad, set())
    with pytest.raises(ValueError):
        expression.compile_factor({"func": "log", "args": [{"var": "x"}]}, {"close"})
    # equal sub-trees share a column, keywords cannot shift
    x = {"func": "moving_average", "args": [{"var": "close"}, 3]}
    plan, _ = expression.compile_factor({"func": "add", "args": [x, x]}, {"close"})
    assert len(plan.steps) == 2
    assert expression.normalise({"func": "sharpe_ratio", "args": {"data": {"var": "close"}, "window": 5.0, "axis": 0.0}})["args"] == {"data": {"var": "close"}, "window": 5, "axis": 0}


def test_register_operator(panel):
    factor.register_operator("half", lambda p, a: p.let(f"{a} / 2"))
    try:
        got = expression.factor_values(panel, {"func": "half", "args": {"a": {"var": "close"}}})
        assert got.where("close is not null and abs(factor * 2 - close) > 1e-12").count() == 0
    finally:
        del factor.OPERATORS["half"]


def test_indicators(panel, wide):
    got = rolling.indicators(panel, ["RSI", "PSY", "OBV", "BollUp-2", "EMA", "KDJ-K-3"], 5)
    rsi, psy = values(got, "RSI"), values(got, "PSY")
    assert rsi.stack().dropna().between(0, 100).all() and psy.stack().dropna().between(0, 100).all()
    d = wide["A"].diff()
    up, down = d.where(d > 0, 0.0).rolling(5).mean(), (-d).where(d < 0, 0.0).rolling(5).mean()
    np.testing.assert_allclose(rsi["A"].iloc[4:], (100 - 100 / (1 + up / down)).iloc[4:], rtol=1e-9)
    ema = values(got, "EMA")
    np.testing.assert_allclose(ema["A"], wide["A"].ewm(span=5, adjust=False).mean(), rtol=1e-12)
    assert values(got, "KDJ_K_3")["D"].round(9).eq(50).all()  # a constant code never moves the lines
    assert (len(rolling.PLAIN) + len(rolling.RECURSIVE)) >= 96


def test_rolling_families_in_pandas(panel):
    """One value or more of every family of indicators, written out for a code without gaps."""
    w, names = 5, ["PriceSigma", "BollUp_2", "L", "H", "RSV", "MTM", "MTMMA_3", "VolMA", "OBV", "MAOBV", "PVT", "VR", "MAVR_3", "PSY", "MAPSY_3", "CCI", "CR", "MACR_10_5", "AR", "BR", "BRARDiff", "BIAS", "MABIAS_5", "TR", "PDI", "MDI", "ADX_6", "ADXR_6_6", "DKX", "MADKX_5"]
    got = rolling.indicators(panel.where("ts_code = 'A'"), names, w).orderBy("trade_date").toPandas()
    o, h, lo, c, v = (got[x].astype(float) for x in ("open", "high", "low", "close", "vol"))
    row = np.arange(1, len(got) + 1)
    part = lambda x, n=w: x.rolling(n, min_periods=1).sum()
    mean = lambda x, n=w: x.rolling(n, min_periods=1).mean().where(row >= n)
    pos = lambda x: x.clip(lower=0)
    pc, move = c.shift(), c.diff()
    top, bottom, mid = h.rolling(w, min_periods=1).max(), lo.rolling(w, min_periods=1).min(), (h.shift() + lo.shift()) / 2
    sigma = c.rolling(w, min_periods=1).std().fillna(0)
    typical = (h + lo + c) / 3
    tr = pd.concat([h - lo, (h - pc).abs(), (lo - pc).abs()], axis=1).max(axis=1)
    up, down = h.diff(), -lo.diff()
    pdi, mdi = (part(x.where((x > y) & (x > 0), 0.0)) / part(tr) * 100 for x, y in ((up, down), (down, up)))
    even = part(v.where(move == 0, 0.0)) / 2
    vr = (part(v.where(move > 0, 0.0)) + even) / (part(v.where(move < 0, 0.0)) + even).replace(0, np.nan) * 100
    cr = part(pos(h - mid)) / part(pos(mid - lo)).replace(0, np.nan) * 100
    ar, br = part(h - o) / part(o - lo) * 100, part(pos(h - pc)) / part(pos(pc - lo)).replace(0, np.nan) * 100
    obv, pvt = (np.sign(move) * v).fillna(0).cumsum(), (move / pc * v).fillna(0).cumsum()
    psy, bias = part((move > 0).astype(float)) / w * 100, (c - mean(c)) / mean(c) * 100
    adx = mean((pdi - mdi).abs() / (pdi + mdi).replace(0, np.nan) * 100, 6)
    base = (3 * c + h + lo + o) / 6
    dkx = sum(base.shift(i) * (20 - i) for i in range(20)) / 210
    want = {"PriceSigma": sigma, "BollUp_2": mean(c) + 2 * sigma, "L": bottom, "H": top, "RSV": (c - bottom) / (top - bottom) * 100, "MTM": c - c.shift(w), "MTMMA_3": mean(c - c.shift(w), 3), "VolMA": mean(v)}
    want |= {"OBV": obv, "MAOBV": mean(obv), "PVT": pvt, "VR": vr, "MAVR_3": mean(vr, 3), "PSY": psy, "MAPSY_3": mean(psy, 3), "CCI": (typical - mean(typical)) / (0.015 * mean((typical - mean(typical)).abs()))}
    want |= {"CR": cr, "MACR_10_5": mean(cr, 10).shift(5), "AR": ar, "BR": br, "BRARDiff": br - ar, "BIAS": bias, "MABIAS_5": mean(bias)}
    want |= {"TR": tr, "PDI": pdi, "MDI": mdi, "ADX_6": adx, "ADXR_6_6": (adx + adx.shift(6)) / 2, "DKX": dkx, "MADKX_5": mean(dkx)}
    assert set(want) == set(names)
    for n in names:
        np.testing.assert_allclose(got[n].astype(float), want[n], rtol=1e-9, atol=1e-9, err_msg=n)


def test_long_table(panel):
    long = rolling.long_table(panel, ["CloseMA", "RSI"], (3, 5))
    assert long.select("metric", "window").distinct().count() == 4
    assert "RSI:5" in rolling.wide_table(long).columns


def test_period_metrics(panel, wide):
    got = period.period_metrics(panel, "10d").toPandas().set_index(["ts_code", "end_date"])
    r = np.log(wide["A"] / wide["A"].shift(1))
    i = 25
    x = r.iloc[i - 9 : i + 1]
    row = got.loc[("A", wide.index[i])]
    assert math.isclose(row["TotalReturn"], x.sum(), rel_tol=1e-9)
    assert math.isclose(row["Volatility"], x.std(), rel_tol=1e-9)
    assert math.isclose(row["ReturnSkewness"], x.skew(), rel_tol=1e-6)
    assert math.isclose(row["ReturnKurtosis"], x.kurt(), rel_tol=1e-6)
    p = wide["A"].iloc[i - 9 : i + 1]
    assert math.isclose(row["MaxDrawDown"], (p / p.cummax() - 1).min(), rel_tol=1e-9)
    assert (got["MinLow"].dropna() <= got["MaxHigh"].dropna()).all() and (got["MaxDrawDown"].dropna() <= 0).all()
    assert len(period.METRICS) + 1 >= 86


def test_calendar_period_is_open_at_its_start(panel, wide):
    rows = period.window_aggregates(panel, ["2w"]).select("ts_code", "end_date", "n_rows", "days").toPandas()
    one = rows[(rows.ts_code == "A") & (rows.end_date.astype(str) == str(wide.index[30]))].iloc[0]
    assert one["n_rows"] == 14 and one["days"] == 14


def test_register_metric(panel):
    period.register_metric("TwiceReturn", "2 * TotalReturn")
    try:
        got = period.period_metrics(panel, "5d", ["TwiceReturn", "TotalReturn"])
        assert got.where("abs(TwiceReturn - 2 * TotalReturn) > 1e-12").count() == 0
        with pytest.raises(ValueError):
            period.register_metric("Volatility", "1")
    finally:
        period.REGISTERED.clear()


def test_hurst_needs_64_returns(panel):
    assert period.hurst(panel, "20d").where("HurstExponent is not null").count() == 0


def test_ic(panel, wide):
    df = expression.factor_values(panel, {"func": "ts_delta", "args": [{"var": "close"}, 1]}).selectExpr("ts_code", "trade_date", "factor", f"{evaluation.forward_returns()} AS forward")
    f, fwd = wide.diff(), wide.shift(-1) / wide - 1
    for ranked, how in ((False, "pearson"), (True, "spearman")):
        got = evaluation.daily_ic(df, ranked).toPandas().set_index("trade_date")["ic"]
        for d in wide.index[3:10]:
            both = pd.DataFrame({"a": f.loc[d], "b": fwd.loc[d]}).dropna()
            want = both["a"].rank().corr(both["b"].rank()) if ranked else both["a"].corr(both["b"])
            assert math.isclose(got.loc[d], want, abs_tol=1e-9), (d, how)
    s = evaluation.ic_summary(evaluation.daily_ic(df)).first()
    assert 0 <= s["p_value"] <= 1


def test_student_tail(spark):
    """Known values, the closed forms of 1, 2 and 4 degrees of freedom, and the normal limit; a tail keeps its digits."""
    pairs = [(2.0, 11, 0.07338803477074052), (0.0, 5, 1.0), (1.0, 1, None), (None, 9, None), (float("nan"), 9, None), (float("inf"), 9, 0.0)]
    for t in (0.01, 0.7, 1.3, 4.0, 30.0, -2.5, 1e4):
        x = abs(t)
        pairs += [(t, 2, 1 - 2 / math.pi * math.atan(x)), (t, 3, 1 - x / math.sqrt(2 + x * x)), (t, 5, 1 - x / math.sqrt(4 + x * x) * (1 + 2 / (4 + x * x)))]
    pairs += [(1.959963984540054, 100_001, 0.0500027730), (5.0, 60_001, 5.74986e-07)]
    got = spark.createDataFrame([p[:2] for p in pairs], "t double, n long").select("t", "n", two_sided_p("t", "n").alias("p")).collect()
    for r, (t, n, want) in zip(got, pairs):
        assert r["p"] is want is None or math.isclose(r["p"], want, rel_tol=1e-6 if n > 1000 else 1e-9, abs_tol=1e-13), (t, n, r["p"], want)
