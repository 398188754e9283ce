"""Numbers of spans against windows that are laid out whole."""

import datetime
import math
from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from test_operators import panel, wide  # noqa: F401

from barsmith.functions import histories
from barsmith.functions.spans import Drawdowns, Extremes, Ranks, Series, significant_digits
from barsmith.operators import factor, period
from barsmith.operators.period import DAILY_RATE
from barsmith.plans import expression

NUMBERS = st.lists(st.one_of(st.none(), st.integers(1, 9)), min_size=1, max_size=30)


def cut(data, n):
    lo = data.draw(st.integers(0, n - 1))
    return np.array([lo]), np.array([data.draw(st.integers(lo + 1, n))])


@settings(max_examples=150, deadline=None)
@given(NUMBERS, st.data())
def test_spans(values, data):
    x = np.array([math.nan if v is None else v for v in values], float)
    lo, hi = cut(data, len(x))
    part = x[lo[0] : hi[0]]
    known = part[~np.isnan(part)]
    s = Series(x)
    assert s.n(lo, hi)[0] == len(known)
    if len(known):
        for got, want in ((s.mean, np.mean), (s.minimum, np.min), (s.maximum, np.max), (s.total, np.sum)):
            assert math.isclose(got(lo, hi)[0], want(known), abs_tol=1e-12)
        for k, got in zip((2, 3, 4), s.central(lo, hi, 4)):
            assert math.isclose(got[0], ((known - known.mean()) ** k).sum(), abs_tol=1e-9)
        assert math.isclose(s.spread(lo, hi, s.mean(lo, hi))[0], np.abs(known - known.mean()).mean(), abs_tol=1e-12)
        shares = (0.0, 0.1, 0.5, 0.83, 1.0)
        assert np.allclose([q[0] for q in s.quantiles(lo, hi, shares)], np.quantile(known, shares))
    else:
        assert np.isnan(s.mean(lo, hi)[0]) and np.isnan(s.quantiles(lo, hi, (0.5,))[0][0])
    fall = {k: v[0] for k, v in Drawdowns(s).at(lo, hi).items()}
    peak = np.fmax.accumulate(np.where(np.isnan(part), -math.inf, part))
    dd = np.where(np.isnan(part), 0, part / peak - 1)
    at = np.flatnonzero(dd == dd.min())[-1]
    assert fall["mdd"] == dd.min() and fall["mdd_row"] == lo[0] + at and math.isclose(fall["dd2"], (dd * dd).sum(), abs_tol=1e-12)
    assert fall["peak_row"] == lo[0] + np.flatnonzero(dd[: at + 1] >= 0)[-1]
    assert fall["highs"] == sum(v > max([w for w in part[:i] if w == w], default=-math.inf) for i, v in enumerate(part))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_ranks_and_extremes(values, data):
    x = np.array(values, float)
    lo, hi = cut(data, len(x))
    part, v = sorted(x[lo[0] : hi[0]]), data.draw(st.integers(-1, 7))
    r = Ranks(x)
    assert [r.kth(lo, hi, np.array([k]))[0] for k in range(len(part))] == part
    for strict in (False, True):
        count, total = r.up_to(lo, hi, np.array([v]), strict)
        below = [w for w in part if w < v or (w == v and not strict)]
        assert (count[0], total[0]) == (len(below), sum(below))
    value, place = Extremes(x).at(lo, hi)
    assert value[0] == min(part) and place[0] == max(i for i in range(lo[0], hi[0]) if x[i] == min(part))


@pytest.mark.parametrize("window", [4, 64, 1024])
def test_steps_do_not_depend_on_the_window(window):
    x = np.random.default_rng(0).normal(size=4000)
    r = Ranks(x)
    hi = np.arange(window, 4001)
    r.quantiles(hi - window, hi, (0.25, 0.5))
    r.up_to(hi - window, hi, x[hi - 1])
    assert r.steps == 3 * 12  # two looks for quantiles, one for ranks, a level for each bit of 4000


def test_significant_digits(spark):
    from barsmith.plans.staged import significant

    x = [0.0, -0.0, 1.0, 123456.7, 1234567.8, -0.00000149, 2.5e-7, 9.9999995, -3.3e17, 1e15, 12.3456785, -12.3456785, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").selectExpr(significant("x")).collect()]
    np.testing.assert_array_equal(significant_digits(np.array(x))[:-1], np.array(got[:-1]))


# --- windows as rows of matrices, apart from the engine's look-ups -----------------------------------------------


def _moments(x: np.ndarray):
    """Number, mean and deviations from it (0 where a value is missing) of each row."""
    known = ~np.isnan(x)
    n = known.sum(axis=1)
    mean = np.where(n > 0, np.where(known, x, 0).sum(axis=1) / np.maximum(n, 1), np.nan)
    return known, n, mean, np.where(known, x - np.where(n > 0, mean, 0)[:, None], 0)


def _deviation(x: np.ndarray, ddof: int) -> np.ndarray:
    _, n, _, dev = _moments(x)
    return np.where(n > ddof, np.sqrt((dev * dev).sum(axis=1) / np.maximum(n - ddof, 1)), np.nan)


def _quantiles(x: np.ndarray, shares: Iterable[float]) -> list[np.ndarray]:
    """Percentiles with linear interpolation of each row's values."""
    x = np.sort(x, axis=1)  # missing ones last
    n = (~np.isnan(x)).sum(axis=1)
    rows_, out = np.arange(len(x)), []
    for q in shares:
        at = q * np.maximum(n - 1, 0)
        low = np.floor(at).astype(int)
        a, b = x[rows_, low], x[rows_, np.minimum(low + 1, np.maximum(n - 1, 0))]
        out.append(np.where(n > 0, a + (b - a) * (at - low), np.nan))
    return out


def _regression(y: np.ndarray, idx: np.ndarray):
    """Sums of squares and products about the means of idx and y, over rows where y is known."""
    known, n, _, dev = _moments(y)
    x = np.where(known, idx, np.nan)
    _, _, _, dx = _moments(x)
    some = n > 0
    return [np.where(some, v, np.nan) for v in ((dx * dx).sum(axis=1), (dev * dev).sum(axis=1), (dx * dev).sum(axis=1))]


def _last_known(x: np.ndarray) -> np.ndarray:
    """The last value before each place of a row that is not missing."""
    at = np.where(np.isnan(x), -1, np.arange(x.shape[1])[None, :])
    at = np.maximum.accumulate(at, axis=1)
    at = np.concatenate([np.full((len(x), 1), -1), at[:, :-1]], axis=1)
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), axis=1), np.nan)


def matrix_numbers(inside: np.ndarray, r: np.ndarray, close: np.ndarray, high: np.ndarray, low: np.ndarray, vol: np.ndarray) -> dict[str, np.ndarray]:
    """The numbers of windows that are laid out as rows of matrices."""
    width = r.shape[1]
    m = inside.sum(axis=1)
    idx = (np.arange(width)[None, :] - (width - m)[:, None]).astype(float)
    known, n, mu, dev = _moments(r)
    z = np.where(known, r, 0)
    count = np.maximum(n, 1)
    mean_of = lambda x, k: np.where(k > 0, x.sum(axis=1) / np.maximum(k, 1), np.nan)
    pos, neg = np.where(r > 0, r, np.nan), np.where(r < 0, r, np.nan)
    n_pos, n_neg = (r > 0).sum(axis=1), (r < 0).sum(axis=1)
    top = lambda x: np.where(np.isnan(x).all(axis=1), np.nan, np.where(np.isnan(x), -np.inf, x).max(axis=1))
    out = {"n_rows": m, "n": n, "tot": z.sum(axis=1), "mu": mu, "sd": _deviation(r, 1), "hi": top(r), "lo": -top(-r)}
    out |= {"pos": np.where(r > 0, r, 0).sum(axis=1), "neg": np.where(r < 0, r, 0).sum(axis=1), "n_pos": n_pos, "n_neg": n_neg}
    for k in (2, 3, 4):
        out[f"m{k}"] = np.where(n > 0, (dev**k).sum(axis=1) / count, np.nan)
    out["mad"] = np.where(n > 0, np.abs(dev).sum(axis=1) / count, np.nan)
    # drawdown of the close from its peak in the window
    peak = np.maximum.accumulate(np.where(np.isnan(close), -np.inf, close), axis=1)
    with np.errstate(all="ignore"):
        dd = np.where(inside & ~np.isnan(close) & (peak != 0), close / peak - 1, 0.0)
    worst = np.where(inside, dd, np.inf).min(axis=1)
    worst_idx = np.where(inside & (dd == worst[:, None]), idx, -1).max(axis=1)
    peak_idx = np.where(inside & (dd >= 0) & (idx <= worst_idx[:, None]), idx, -1).max(axis=1)
    out |= {"mdd": worst, "mdd_idx": worst_idx, "peak_idx": np.where(peak_idx >= 0, peak_idx, np.nan), "dd2": (np.where(inside, dd, 0) ** 2).sum(axis=1) / np.maximum(m, 1)}
    outside = lambda x: np.where(inside, x, np.nan)
    out |= {"down": _deviation(outside(np.where(r < DAILY_RATE, r - DAILY_RATE, 0.0)), 1), "up": _deviation(outside(np.where(r > 0, r, 0.0)), 1)}
    out |= {"pos_sd": _deviation(pos, 0), "pos_mu": _moments(pos)[2], "neg_sd": _deviation(neg, 0), "neg_mu": _moments(neg)[2]}
    out |= {"gains": np.where(r > DAILY_RATE, r - DAILY_RATE, 0).sum(axis=1), "losses": np.where(r < DAILY_RATE, DAILY_RATE - r, 0).sum(axis=1)}
    out["sxx"], out["syy"], out["sxy"] = _regression(np.where(known, np.cumsum(z, axis=1), np.nan), idx)
    with np.errstate(all="ignore"):
        out["pxx"], out["pyy"], out["pxy"] = _regression(np.where(close > 0, np.log(close), np.nan), idx)
    _, n_low, _, low_dev = _moments(np.where(r < DAILY_RATE, r, np.nan))
    out["low3"] = mean_of(low_dev**3, n_low)
    out |= {"v_mu": _moments(vol)[2], "v_sd": _deviation(vol, 1)}
    out["vxx"], _, out["vxy"] = _regression(vol, idx)
    out |= {"max_high": top(high), "min_low": -top(-low), "avg_high": _moments(high)[2], "avg_low": _moments(low)[2], "n_close": (~np.isnan(close)).sum(axis=1)}
    before = np.concatenate([np.full((len(r), 1), -np.inf), peak[:, :-1]], axis=1)
    out["highs"] = (close > before).sum(axis=1)
    out["med"], *rest = _quantiles(r, (0.5, 0.01, 0.05, 0.1, 0.9, 0.95, 0.99))
    out |= dict(zip(("q1", "q5", "q10", "q90", "q95", "q99"), rest))
    out["win90"], out["win95"] = _quantiles(pos, (0.9, 0.95))
    out["lose90"], out["lose95"] = _quantiles(-neg, (0.9, 0.95))
    some = np.concatenate([np.zeros((len(r), 1)), np.cumsum(known, axis=1)], axis=1)
    for k in (1, 5, 10):
        x = r
        if k > 1:  # sums of whole blocks of rows, at their last row
            ends = inside & (idx % k == k - 1)
            x = np.full(r.shape, np.nan)
            sums = np.nansum(np.lib.stride_tricks.sliding_window_view(r, k, axis=1), axis=-1) if r.shape[1] >= k else r[:, :0]
            x[:, k - 1 :] = np.where(ends[:, k - 1 :] & (some[:, k:] > some[:, :-k]), sums, np.nan)
        was = _last_known(x)
        for name, a, b in (("ww", was >= 0, x >= 0), ("ll", was < 0, x < 0), ("wl", was >= 0, x < 0), ("lw", was < 0, x >= 0)):
            out[f"{name}{k}"] = (a & b).sum(axis=1)
    return out




COLUMNS = ("r", "close", "high", "low", "vol")


def history(close, vol):
    """One code's columns, its returns from one known close to the next."""
    r, before = np.full(len(close), np.nan), np.nan
    for t, v in enumerate(close):
        if v == v:
            r[t], before = (np.log(v / before) if before == before else np.nan), v
    return r, close, close * 1.01, close * 0.98, vol


def codes(histories_):
    no = np.concatenate([np.arange(1, len(h[0]) + 1) for h in histories_])
    days = pa.array([datetime.date(2000, 1, 1) + datetime.timedelta(int(i)) for i in no])
    return period.Codes(pa.table({"_no": no, "trade_date": days, **{c: np.concatenate([h[i] for h in histories_]) for i, c in enumerate(COLUMNS)}}))


def some_history(rng, kind):
    n = int(rng.integers(8, 160))
    close = np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 10.0 ** rng.integers(-1, 4)
    if kind == 1:
        close = np.full(n, 7.0)
    if kind == 2:
        close = np.maximum(close, np.median(close))
    gap = rng.random(n) < (0.3 if kind else 0)
    return history(np.where(gap, np.nan, close), np.where(gap, np.nan, rng.integers(0, 5, n) * 10.0 ** rng.integers(0, 6)))


@pytest.mark.parametrize("seed", range(12))
def test_window_numbers(seed):
    """Codes of many sizes side by side, with gaps, standing prices and repeated ones."""
    rng = np.random.default_rng(seed)
    given_ = [some_history(rng, k % 4) for k in range(6)]
    c = codes(given_)
    h = period.History(c)
    for days in (2, 3, 10, 40):
        lo, hi, _ = c.spans(f"{days}d")
        got = h.numbers(lo, hi)
        for i, first in enumerate(c.first):
            own = (lo >= first) & (hi <= first + len(given_[i][0]))
            ends = hi[own] - 1 - first
            if not len(ends):
                continue
            place = ends[:, None] + np.arange(1 - days, 1)[None, :]
            want = matrix_numbers(np.ones(place.shape, bool), *(x[place] for x in given_[i]))
            for name, v in want.items():
                v = np.asarray(v, float)
                size = np.nanmax(np.abs(given_[i][4])) * days**2 if name in ("vxx", "vxy", "v_sd", "v_mu") else 1
                np.testing.assert_allclose(np.asarray(got[name][own], float), v, rtol=1e-7, atol=1e-11 * size, err_msg=f"{name} {days} {i}")


def test_prices_of_zero_and_below():
    close = np.array([2.0, 0.0, -1.0, 3.0, np.nan, 1.0, 4.0, 2.0])
    h = period.History(codes([(np.full(8, 0.1), close, close, close, np.ones(8))]))
    lo, hi = np.array([0, 1, 3]), np.array([8, 4, 8])
    for i, (a, b) in enumerate(zip(lo, hi)):
        part = close[None, a:b]
        want = matrix_numbers(np.ones(part.shape, bool), np.full(part.shape, 0.1), part, part, part, np.ones(part.shape))
        got = h.numbers(lo, hi)
        for name in ("mdd", "mdd_idx", "peak_idx", "dd2", "highs"):
            assert float(got[name][i]) == float(np.asarray(want[name], float)[0]), name


def test_passes_take_whole_groups(panel, monkeypatch):
    """Any size of a step gives the same: groups are never cut."""
    names = [c for c in period.METRICS]
    whole = period.period_catalogue(panel, ["10d", "2w"], names).orderBy("ts_code", "end_date", "period").toPandas()
    rows = [pa.record_batch({"_no": np.array(n), "x": np.arange(len(n))}) for n in ([1, 2, 3, 1], [2, 3], [4, 5, 1, 1, 2], [1])]
    monkeypatch.setattr(histories, "ROWS", 1)
    parts = [t.column("_no").to_pylist() for t in histories.whole_groups(iter(rows))]
    assert parts == [[1, 2, 3], [1, 2, 3, 4, 5, 1], [1, 2], [1]] or all(p[0] == 1 for p in parts) and sum(parts, []) == [1, 2, 3, 1, 2, 3, 4, 5, 1, 1, 2, 1]
    assert len(whole) == whole.groupby(["ts_code", "end_date", "period"]).ngroups and set(whole["period"]) == {"10d", "2w"}
    assert list(histories.whole_groups(iter([]))) == []


def test_order_statistics_of_rows(panel, wide):
    """rolling_quantile and ts_rank against pandas, along time and across codes."""
    tree = {"q": {"func": "rolling_quantile", "args": [{"var": "close"}, 5, 0.3]}, "k": {"func": "ts_rank", "args": [{"var": "close"}, 5]}, "q1": {"func": "rolling_quantile", "args": [{"var": "close"}, 2, 0.5, 1]}}
    plan, out = factor.FactorPlan(), {}
    for n, t in tree.items():
        out[n] = expression.compile_node(plan, expression.normalise(t), {"close"})
    got = plan.apply(panel).selectExpr("ts_code", "trade_date", *(f"{c} AS {n}" for n, c in out.items())).toPandas()
    for n, want in (("q", wide.rolling(5, min_periods=1).quantile(0.3).iloc[4:].reindex(wide.index)), ("q1", wide.T.rolling(2, min_periods=1).quantile(0.5).T)):
        mine = got.pivot(index="trade_date", columns="ts_code", values=n)[wide.columns]
        keep = want.columns[1:] if n == "q1" else want.columns
        np.testing.assert_allclose(mine[keep].to_numpy(float), want[keep].to_numpy(float), rtol=1e-12)
    mine = got.pivot(index="trade_date", columns="ts_code", values="k")
    x = wide["A"].to_numpy()
    for i in range(4, len(x)):
        part = x[i - 4 : i + 1]
        part = part[~np.isnan(part)]
        if x[i] == x[i] and len(part) > 1:
            assert math.isclose(mine["A"].iloc[i], ((part < x[i]).sum() + ((part == x[i]).sum() - 1) / 2) / (len(part) - 1))


@pytest.mark.parametrize("name", ["screen_long", "screen_short", "screen_run_atr", "screen_ratio_low", "screen_below_streak", "screen_summary", "period_5d", "relative_2y_25d", "factor_moments"])
def test_generated_code_compiles(spark, sf, name):
    """No plan is so large that its generated code fails to compile and falls back."""
    from barsmith.catalogue import QUERIES

    kept = spark.conf.get("spark.sql.codegen.fallback")
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", kept)


@pytest.mark.parametrize("name,scans", [("panel_events", 1), ("panel_lineitem", 1), ("factor_cross_section", 2), ("eval_rank_ic", 1), ("period_catalogue", 1), ("benchmark_min_var", 1)])
def test_tables_are_scanned_once(spark, sf, name, scans):
    from barsmith.catalogue import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert 1 <= plan.count("Scan parquet ") <= scans


def test_digits_of_windows_that_are_all_but_a_line():
    """Beside long histories of large returns a window keeps its digits: residual of its line, its small falls, its small moments."""
    rng = np.random.default_rng(3)
    n, days = 8000, 30
    own = [None, 0.1, None, -0.6066145779171565, -0.19664667575340936, None, -0.393161345903227]
    falls = [400.0, 400.0, None, 0.31, 0.30999, None, 0.309985]
    calm = [None, 0.1, 0.7, 0.7000001, 0.7000003, 0.69999995, 0.7]
    r = np.concatenate([rng.normal(0, 3, n), *(np.array(x, float) for x in (own, calm))])
    close = np.concatenate([rng.uniform(0.01, 500, n), np.array(falls, float), np.full(7, 1.0)])
    no = np.concatenate([np.arange(n) % days + 1, np.arange(7) + 1, np.arange(7) + 1])
    day = [datetime.date(2024, 1, 1) + datetime.timedelta(int(k)) for k in no]
    plain = pa.array(np.ones(len(r)))
    t = pa.table({"ts_code": ["C"] * len(r), "trade_date": pa.array(day, pa.date32()), "_no": pa.array(no), "r": pa.array(r, mask=np.isnan(r)), "close": pa.array(close, mask=np.isnan(close)), "high": plain, "low": plain, "vol": plain})
    lo, hi = np.array([n + 2, n + 9]), np.array([n + 7, n + 14])
    x = period.History(period.Codes(t)).numbers(lo, hi)
    total, points = Fraction(0), []
    for i, v in enumerate(own[2:]):
        if v is not None:
            total += Fraction(v)
            points.append((i, total))
    mx, my = (sum(p[k] for p in points) / Fraction(len(points)) for k in (0, 1))
    xx, yy, xy = (sum((a[i] - m[i]) * (a[j] - m[j]) for a in points for m in [(mx, my)]) for i, j in ((0, 0), (1, 1), (0, 1)))
    assert math.isclose(x["syy"][0] - x["sxy"][0] ** 2 / x["sxx"][0], float(yy - xy * xy / xx), rel_tol=1e-6)
    top = Fraction(0.31)
    assert math.isclose(x["dd2"][0], float(((Fraction(0.30999) / top - 1) ** 2 + (Fraction(0.309985) / top - 1) ** 2) / 5), rel_tol=1e-9)
    values = [Fraction(v) for v in calm[2:]]
    mean = sum(values) / 5
    for k in (2, 3, 4):
        assert math.isclose(x[f"m{k}"][1], float(sum((v - mean) ** k for v in values) / 5), rel_tol=1e-7), k
