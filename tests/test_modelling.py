"""Relative metrics, long-short lines, feature preparation, portfolios and stored tables against pandas and NumPy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith.operators import factor, prepare, relative, rolling
from barsmith.plans import expression, features, modelling, orders, portfolio
from barsmith.plans.staged import shown
from barsmith.sources import bars as source

FIRST = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def wide():
    """Two codes over 500 weekdays, one of them with gaps and a late start."""
    rng = np.random.default_rng(11)
    days = pd.bdate_range(FIRST, periods=500)
    close = pd.DataFrame(50 * np.exp(np.cumsum(rng.normal(0, 0.02, (500, 2)), axis=0)), index=days, columns=["A", "B"])
    close.loc[close.index[:70], "B"] = np.nan
    close.loc[close.index[[120, 121, 300]], "B"] = np.nan
    return close


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows, rng = [], np.random.default_rng(12)
    for c in wide:
        r = np.log(wide[c] / wide[c].shift(1))
        for d, v, x in zip(wide.index, wide[c], r):
            v, x = (None if v != v else float(v)), (None if x != x else float(x))
            up = float(rng.random())
            rows.append((c, d.date(), v, None if v is None else v + up, None if v is None else v - up, v, None if v is None else float(rng.integers(1, 99)), 1.0, x))
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, vol double, amount double, log_return double").cache()


def series(df, name, code):
    p = df.where(F.col("ts_code") == code).select("trade_date", name).toPandas().sort_values("trade_date")
    return pd.Series(p[name].to_numpy(float), index=pd.to_datetime(p["trade_date"]))


@pytest.mark.parametrize("current,history", [("5d", "2m"), ("25d", "1y"), ("5m", "1y"), ("1d", "6m")])
def test_relative_metrics(panel, wide, current, history):
    got = relative.relative_metrics(panel, current, history).cache()
    months = {"2m": 2, "6m": 6, "1y": 12}[history]
    for code in wide:
        r = np.log(wide[code] / wide[code].shift(1))
        first = r.first_valid_index()

        def window(end, span):
            if span.endswith("d"):
                at = r.index.get_loc(end)
                return r.iloc[at + 1 - int(span[:-1]) : at + 1] if at >= int(span[:-1]) else None
            start = end - pd.DateOffset(months=int(span[:-1]) * (12 if span[-1] == "y" else 1))
            return r[(r.index > start) & (r.index <= end)] if start >= r.index[0] else None

        now = {d: window(d, current) for d in r.index}
        level = pd.Series({d: w.mean() if w is not None else np.nan for d, w in now.items()})
        total = pd.Series({d: w.sum(min_count=1) if w is not None else np.nan for d, w in now.items()})
        vol = pd.Series({d: w.std() if w is not None else np.nan for d, w in now.items()})
        cols = {b: series(got, f"{b}_{history}", code) for b in relative.BASES}
        for d in r.index[::17]:
            start = d - pd.DateOffset(months=months)
            past = r[(r.index > start) & (r.index <= d)]
            if start < r.index[0] or first > start:
                assert all(math.isnan(s[d]) for s in cols.values())
                continue
            same = lambda x: (lambda p: (p <= x[d]).sum() / p.notna().sum() if x[d] == x[d] else np.nan)(x[(x.index > start) & (x.index <= d)])
            want = {"ReturnZScore": (level[d] - past.mean()) / past.std(), "ReturnPercentile": same(total), "AverageDeviationReturn": (level[d] - past.mean()) / past.mean(), "VolatilityRollingRatio": vol[d] / past.std(), "VolatilityPercentile": same(vol)}
            for b, w in want.items():
                np.testing.assert_allclose(cols[b][d], w, rtol=1e-7, err_msg=f"{code} {b} {d}")


def test_long_short_lines(panel, wide):
    got = relative.long_short_lines(panel).cache()
    a = wide["A"]
    ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
    dif = ema(a, 12) - ema(a, 26)
    want = {"BBI": sum(a.rolling(n).mean() for n in (3, 6, 12, 24)) / 4, "DMA": (a.rolling(10).mean() - a.rolling(50).mean()).rolling(10).mean(), "DIF": dif, "DEA": ema(dif, 9), "MACD": 2 * (dif - ema(dif, 9))}
    for name, w in want.items():
        np.testing.assert_allclose(series(got, name, "A"), w.to_numpy() if name != "DMA" else np.where(np.arange(500) < 58, np.nan, w), rtol=1e-9, atol=1e-9, err_msg=name)
    adx = series(rolling.indicators(panel, ["ADX-6"], 14), "ADX_6", "A").to_numpy()
    slope = series(got, "ADXSlop_6", "A").to_numpy()
    for i in (60, 200, 499):
        np.testing.assert_allclose(slope[i], np.polyfit(np.arange(6), adx[i - 5 : i + 1], 1)[0], rtol=1e-6)
    assert len(relative.METRICS) + len(relative.LINES) == 26


def test_windows_in_one_plan_equal_one_by_one(panel):
    metrics = ["RSI", "BIAS", "KDJ-K-3"]
    both = rolling.wide(panel, metrics, (3, 9)).orderBy("ts_code", "trade_date").toPandas()
    for w in (3, 9):
        one = rolling.indicators(panel, metrics, w).orderBy("ts_code", "trade_date").toPandas()
        for m in map(rolling.column, metrics):
            np.testing.assert_allclose(both[f"{m}_{w}"].to_numpy(float), one[m].to_numpy(float), rtol=1e-9)
    plan = features.assemble(panel, ("RSI", "PSY"), (3, 5, 10))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_merge_is_outer(spark):
    a = spark.createDataFrame([("x", FIRST, 1.0)], "ts_code string, trade_date date, p double")
    b = spark.createDataFrame([("x", FIRST, 2.0, 9.0), ("y", FIRST, 3.0, None)], "ts_code string, trade_date date, q double, p double")
    got = {r["ts_code"]: (r["p"], r["q"]) for r in modelling.merge_tables([a, b]).collect()}
    assert got == {"x": (1.0, 2.0), "y": (None, 3.0)}


def test_assembly_joins_all_kinds(panel):
    got = modelling.assemble(panel, ("RSI",), (5,), ("Volatility", "MaxDrawDown"), ("5d", "2m"), (("5d", "2m"),))
    assert {"close", "RSI_5", "Volatility_5d", "MaxDrawDown_2m", "ReturnZScore_2m_5d"} <= set(got.columns)
    assert got.count() == panel.count()


def test_preparation_is_fitted_on_the_training_part(spark, panel):
    rows = panel.select("ts_code", "trade_date", "close", "vol", "log_return")
    train, test = modelling.prepare(rows, ["vol", "log_return"], 5, 0.0, "2021-03-31", "2021-04-01", "2021-12-31", fill="median")
    part = rows.where("trade_date <= '2021-03-31'").toPandas()
    lo, hi = part["vol"].min(), part["vol"].max()
    raw = rows.where("trade_date between '2021-04-01' and '2021-12-31' and vol is not null").orderBy("ts_code", "trade_date").toPandas()
    got = test.join(spark.createDataFrame(raw[["ts_code", "trade_date"]]), ["ts_code", "trade_date"], "left_semi").orderBy("ts_code", "trade_date").toPandas()
    np.testing.assert_allclose(got["vol"], (raw["vol"] - lo) / (hi - lo))
    mean, dev = part["log_return"].fillna(part["log_return"].median()).mean(), part["log_return"].fillna(part["log_return"].median()).std(ddof=0)
    np.testing.assert_allclose(got["log_return"], (raw["log_return"].fillna(part["log_return"].median()) - mean) / dev, rtol=1e-9)
    assert train.where("vol is null").count() == 0 and set(r[0] for r in train.select("label").distinct().collect()) == {0, 1}


def test_sequences(panel):
    train, test = modelling.prepare_sequence(panel.where("ts_code = 'B'"), ["vol", "log_return"])
    t = train.toPandas()
    assert len(t) == int(0.8 * (len(t) + test.count())) and t["trade_date"].max() < test.toPandas()["trade_date"].min()
    assert abs(t["vol"].mean()) < 1e-9 and abs(t["vol"].std(ddof=0) - 1) < 1e-9 and t["close"].min() > 1


def test_cross_features(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(a * b + 0.01 * c)) for a, b, c in zip(x, y, rng.normal(size=400))], "a double, b double, t double")
    chosen = modelling.cross_features(df, ["a", "b"], "t", 3)
    assert next(iter(chosen)) == "product_a_b"
    out = modelling.with_cross_features(df, chosen).first()
    assert math.isclose(out["product_a_b"], out["a"] * out["b"])


def test_tuning_and_boosting(spark):
    rng = np.random.default_rng(4)
    rows = [(FIRST + dt.timedelta(days=i // 4), float(a), float(b), int(a + 0.3 * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "trade_date date, a double, b double, label int")
    for early, late in modelling.time_folds(df, 3):
        assert early.agg(F.max("trade_date")).first()[0] < late.agg(F.min("trade_date")).first()[0]
    best, top = modelling.tune(df, ["a", "b"], n_iter=2, folds=1, limits={"numTrees": (2, 4), "maxDepth": (2, 4)})
    assert set(best) == {"numTrees", "maxDepth", "minInstancesPerNode"} and top > 0.8
    assert modelling.draw_parameters("GBTClassifier", 2) == modelling.draw_parameters("GBTClassifier", 2)
    out = modelling.boost(df.where("trade_date < '2020-03-20'"), df.where("trade_date >= '2020-03-20'"), ["a", "b"], setting={"maxIter": 2})
    assert out.where("prediction = label").count() > 0.8 * out.count()
    assert len(features.important_features(df, ["a", "b"])) == 2


def test_threshold_equals_trying_all(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < s).astype(int)
    got = features.optimal_threshold(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")).first()
    f1 = {t: 2 * y[s >= t].sum() / ((s >= t).sum() + y.sum()) for t in set(s)}
    assert math.isclose(got["f1"], max(f1.values())) and math.isclose(f1[got["threshold"]], got["f1"])


def test_max_sharpe(panel, wide):
    got = portfolio.max_sharpe(panel, 300).collect()
    r = np.log(wide / wide.shift(1))
    mu, cov = r.mean() * 252, r.cov() * 252
    w = np.array([x["weight"] for x in sorted(got, key=lambda x: x["ts_code"])])
    assert abs(w.sum() - 1) < 1e-12 and math.isclose(got[0]["sharpe"], w @ mu / math.sqrt(w @ cov @ w), rel_tol=1e-9)
    assert [x.asDict() for x in got] == [x.asDict() for x in portfolio.max_sharpe(panel, 300).collect()]


def test_orders(spark):
    """Orders are filled a day later, a loss beyond the limit sells, days without a price change nothing."""
    close = [10.0, 10.0, 11.0, None, 10.0, 10.5, 12.0]
    rows = [("A", FIRST + dt.timedelta(days=i), c, None if c is None else c + 1, None if c is None else c - 1, c, None if i in (0, 3) else 0.01 * (i - 3), o) for i, (c, o) in enumerate(zip(close, [1, 0, 0, 1, 0, 1, 0]))]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, log_return double, order int")
    got = orders.replay_orders(df, "plain", "trend", 1000.0, 0.01, 0.0, -0.05).orderBy("trade_date").collect()
    held = 1000 * 0.99 / 10
    assert [r["held"] for r in got] == [False, True, True, True, True, True, True]
    assert [round(r["value"], 9) for r in got] == [1000.0, *(round(held * c, 9) for c in (10, 11, 11, 10, 10.5, 12))]
    assert [r["executed"] for r in got] == [0, 1, 0, 0, 1, 0, 1] and math.isclose(got[1]["reward"], 0.02 - 0.05) and math.isclose(got[4]["reward"], 0.01 - 0.05)
    stopped = orders.replay_orders(df, "extreme", "downside", 1000.0, 0.01, 0.5, -0.05).orderBy("trade_date").collect()
    assert [r["executed"] for r in stopped][:3] == [0, 1, 0] and stopped[1]["value"] == 1000 * 0.99 / 11 * 10
    assert stopped[4]["executed"] == -1 and math.isclose(stopped[4]["value"], 1000 * 0.99 / 11 * 9 * 0.99)
    slips = orders.replay_orders(df, "open", "pnl", 1000.0, 0.0, 0.25, -0.9).orderBy("trade_date").collect()
    assert math.isclose(slips[1]["value"], 800.0) and math.isclose(slips[1]["reward"], -20.05)
    with pytest.raises(ValueError):
        orders.replay_orders(df, reward="none")


def test_search_over_tiles(spark):
    """Tiles of any size give the risks of the whole matrix over common days; a code with one day has none with others."""
    rng = np.random.default_rng(9)
    r = pd.DataFrame(rng.normal(0.001, 0.02, (60, 9)), index=pd.bdate_range(FIRST, periods=60), columns=list("ABCDEFGHI"))
    r = r.mask(rng.random(r.shape) < 0.2)
    r.loc[r.index[1:], "I"] = np.nan
    r.loc[r.index[0], "I"] = 0.01
    panel = spark.createDataFrame([(c, d.date(), float(v)) for c in r for d, v in r[c].items() if v == v], "ts_code string, trade_date date, log_return double")
    hashes = np.array([x[0] for x in spark.createDataFrame([(c,) for c in r], "c string").select(F.xxhash64("c")).collect()]).view(np.uint64)
    w = portfolio.draw_weights(hashes, np.arange(40), 5)
    cov, mu = r.cov().fillna(0).to_numpy() * 252, r.mean().to_numpy() * 252
    for tile in (1, 4, 100):
        got = portfolio.search(panel, 40, 5, tile).orderBy("draw").toPandas()
        np.testing.assert_allclose(got["risk"], ((w @ cov) * w).sum(axis=1), rtol=1e-9)
        np.testing.assert_allclose(got["gain"], w @ mu, rtol=1e-9)
    assert 0 <= w.min() and w.max() < 1 and abs(w.mean() - 0.5) < 0.05
    assert portfolio.max_sharpe(panel.limit(0), 10).collect() == []


def test_replay_of_weights(spark):
    days = [FIRST + dt.timedelta(days=i) for i in range(4)]
    price = {"A": [10.0, 11.0, 12.1, 12.1], "B": [20.0, 20.0, 18.0, 18.0]}
    rows = [("p", d, c, price[c][i], {"A": 1.0, "B": 0.0}[c], -50.0) for i, d in enumerate(days) for c in price]
    df = spark.createDataFrame(rows, "portfolio string, trade_date date, ts_code string, close double, action double, cash_action double")
    free = portfolio.replay_weights(df, 100.0, 0.0).orderBy("trade_date").toPandas()
    a, b = math.e / (math.e + 1), 1 / (math.e + 1)
    want = [100.0]
    for i in range(3):
        want.append(want[-1] * (a * price["A"][i + 1] / price["A"][i] + b * price["B"][i + 1] / price["B"][i]))
    np.testing.assert_allclose(free["value"], want, rtol=1e-9)
    paid = portfolio.replay_weights(df, 100.0, 0.01).orderBy("trade_date").toPandas()
    # only what is sold pays: nothing at first, when all is cash, then for each change
    assert math.isclose(paid["value"][1], free["value"][1]) and (paid["value"].iloc[2:] < free["value"].iloc[2:]).all()
    before, after, fee = np.array([0.1, 0.6, 0.3]), np.array([0.2, 0.3, 0.5]), 0.01
    mu = portfolio.remainder(before, after, fee)
    assert math.isclose(mu, (1 - fee * 0.2 - (2 * fee - fee**2) * max(0, 0.6 - mu * 0.3)) / (1 - fee * 0.2), rel_tol=1e-9)


def test_replay_of_allocations(spark):
    days = [FIRST + dt.timedelta(days=i) for i in range(5)]
    rows = [("p", d, c, {"A": 0.1, "B": -0.1}[c], {"A": 1.0, "B": 0.0}[c]) for d in days for c in ("A", "B")]
    df = spark.createDataFrame(rows, "portfolio string, trade_date date, ts_code string, log_return double, action double")
    got = portfolio.replay_allocations(df, window=3).orderBy("trade_date").toPandas()
    np.testing.assert_allclose(got["value"], np.exp([0, 0.1, 0.2, 0.3, 0.4]), rtol=1e-12)
    np.testing.assert_allclose(got["reward"], [0, 0.1, 0.1 - 0.1 * np.std([0, 0.1, 0.1]), 0.1, 0.1], rtol=1e-9, atol=1e-15)


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "etf_daily.parquet")
    row = lambda c, i, v: (c, FIRST + dt.timedelta(days=i), v)
    make = lambda rows: spark.createDataFrame(rows, "ts_code string, trade_date date, close double")
    assert source.upsert_table(spark, path, make([row("a", 0, 1.0), row("a", 1, 2.0)])) is None
    old = source.upsert_table(spark, path, make([row("a", 1, 5.0), row("b", 1, 6.0)]))
    assert sorted(r["close"] for r in spark.read.parquet(path).collect()) == [1.0, 5.0, 6.0]
    assert spark.read.parquet(old).count() == 2
    make([row("c", 0, 9.0)]).write.parquet(str(tmp_path / "more" / "x_daily.parquet"))
    got = source.read_dir(spark, str(tmp_path / "more"), "*.parquet")
    assert got.count() == 1 and source.read_dir(spark, str(tmp_path / "more"), "*.parquet", without=("part",)).count() == 0


def test_names_and_texts(spark, panel):
    docs = factor.operator_docs(spark)
    assert docs.where("signature like '%window%'").count() > 5
    got = expression.factor_values(panel, '{"func": "moving_average", "args": [{"var": "close"}, 3]}')
    assert got.where("factor is not null").count() > 0
    with pytest.raises(ValueError):
        expression.from_json("{")
    end = prepare.common_end(panel.where("ts_code = 'A' or trade_date < '2021-01-01'"))
    assert end.agg(F.max("trade_date")).first()[0] < dt.date(2021, 1, 1)


def test_infinite_values_are_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(source.nan_to_null(F.col("x"))).collect()] == [None, None, None, 1.0]


def test_a_plan_gathers_its_statistics_at_once(panel):
    plan = factor.FactorPlan()
    for column in ("close", "vol", "high"):
        expression.compile_node(plan, expression.normalise({"func": "winsorize", "args": [{"var": column}]}), {column})
    whole = [name for kind, name, _ in plan.steps if kind == "whole"]
    text = plan.apply(panel)._jdf.queryExecution().analyzed().toString()
    assert len(whole) == 6 and text.count("Aggregate") == 1


def test_rounding_of_numbers_beyond_a_long(spark):
    """Spark's floor is a long, the checking engine's a double: a number beyond 9.2e12 stays itself."""
    values = [2392089766029732.0, -5e14, 1e300, 9.3e12, 0.1234567, -0.0000004, 12345678.1234565]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").selectExpr(shown("x")).collect()]
    assert got == [math.floor(v * 10**6 + 0.500001) / 10**6 for v in values]


def test_replay_of_a_price_that_falls_to_nothing(spark):
    """What a purchase of all leaves by rounding is all there is on a day at 0: it is one product with the whole cost, and deviations add up day by day."""
    price, action, n = [3.7, 0.0, 5.1, 0.3, 11.9, 0.0, 2.2], [1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0], 7
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), price[i], action[i]) for i in range(n)], "ts_code string, trade_date date, close double, action double")
    money, shares, equity = 10_000.0, 0.0, []
    for p, a in zip(price, action):
        if p > 0:
            step = a * (money + shares * p) / p - shares
            step = min(step, money / (p * 1.0005 * 1.001)) if step > 0 else step
            money, shares = money - step * p * (1.0015005 if step > 0 else 0.9985005), shares + step
        equity.append(money + shares * p)
    done = features.replay(rows)
    assert [r["equity"] for r in done.orderBy("trade_date").collect()] == equity
    r = [b / a - 1 for a, b in zip(equity, equity[1:]) if a != 0]
    mean = m2 = 0.0
    for k, x in enumerate(r, 1):
        new = mean + (x - mean) / k
        m2, mean = m2 + (x - new) * (x - mean), new
    assert features.episode_stats(done).first()["volatility"] == math.sqrt(m2 / (len(r) - 1)) * math.sqrt(252)


def test_search_by_kinds_of_codes():
    """Codes that know the same days add up by day: the same risks as from all covariances, in steps that grow with the codes."""
    rng = np.random.default_rng(5)
    kinds = (rng.random((6, 12)) < 0.7) | (np.arange(12) < 1)
    m = np.concatenate([kinds[rng.integers(0, 6, 500)], np.eye(12)[:2] > 0]).astype(float)  # two codes with one day each
    x = rng.normal(size=m.shape) * m
    codes = rng.integers(0, 1 << 63, len(m)).astype(np.uint64)
    left, right = (tuple(v[part] for v in (codes, x, m)) for part in (slice(0, 300), slice(300, None)))
    for a, b in ((left, right), (left, left), (right, right)):
        held = [portfolio._kinds(a[2]), portfolio._kinds(b[2])]
        assert len(held[0][2]) <= 6 + 2
        for got, want in zip(portfolio._by_kinds(a, b, held, 50, 7), portfolio._by_codes(a, b, 50, 7)):
            np.testing.assert_allclose(got, want, rtol=1e-9)


def test_search_pairs_kinds_not_codes(spark, monkeypatch):
    """600 codes of three kinds are one tile, not a task for each pair of five tiles of codes."""
    days = [dt.date(2024, 1, 1 + i) for i in range(8)]
    rows = [(f"C{i}", d, math.sin(i * 7 + j)) for i in range(600) for j, d in enumerate(days) if j != i % 3]
    asked, sequence = [], F.sequence
    monkeypatch.setattr(portfolio.F, "sequence", lambda a, b: asked.append(str(b)) or sequence(a, b))
    found = portfolio.search(spark.createDataFrame(rows, "ts_code string, trade_date date, log_return double"), 20, 3)
    assert asked == ["Column<'0'>"]  # the last tile
    wide = pd.DataFrame(rows, columns=["c", "d", "r"]).pivot(index="d", columns="c", values="r")
    hashes = {r["c"]: r["h"] for r in spark.createDataFrame([(c,) for c in wide], "c string").selectExpr("c", "xxhash64(c) AS h").collect()}
    w = portfolio.draw_weights(np.array([hashes[c] for c in wide], np.int64).view(np.uint64), np.arange(20), 3)
    got = found.orderBy("draw").toPandas()
    np.testing.assert_allclose(got["risk"], np.einsum("di,ij,dj->d", w, wide.cov(min_periods=2).fillna(0).to_numpy(), w) * 252, rtol=1e-9)
    np.testing.assert_allclose(got["gain"], w @ wide.mean().to_numpy() * 252, rtol=1e-9)


def test_sets_of_unknown_days_equal_pairs(monkeypatch):
    """However few codes are paired, a set of unknown days and those that go on from it give the risk of all covariances."""
    rng = np.random.default_rng(3)
    q = rng.random((300, 14)) < 0.15
    q = q[q.sum(axis=1) <= 6]
    q = q[np.argsort(q.sum(axis=1), kind="stable")]
    x = rng.normal(size=q.shape) * ~q
    codes = rng.integers(0, 1 << 63, len(q)).astype(np.uint64)
    want = portfolio._by_codes((codes, x, ~q * 1.0), (codes, x, ~q * 1.0), 30, 7)[1]
    w = portfolio._code_weights(codes, np.arange(30), 7)
    assert (w == portfolio.draw_weights(codes, np.arange(30), 7).T).all()
    for few in (1000, 20, 0):
        monkeypatch.setattr(portfolio, "PAIRED", few)
        np.testing.assert_allclose(portfolio._below(w, x, q, q.sum(axis=1), 0, -1), want, rtol=1e-9)


@pytest.mark.parametrize("odd", [0, 2])
def test_search_does_not_pair_codes_with_days_of_their_own(spark, monkeypatch, odd):
    """1200 codes that nearly all know days of their own go by sets of unknown days; only odd ones with few days meet all others."""
    rng = np.random.default_rng(8)
    known = rng.random((1200, 14)) > 0.15
    known[known.sum(axis=1) < 8] = True
    known[:odd] = np.arange(14) < 1 + np.arange(odd)[:, None]  # one day, two days
    rows = [(f"C{i}", dt.date(2024, 1, 1 + int(j)), math.sin(i * 14 + j)) for i, j in zip(*np.nonzero(known))]
    asked, sequence = [], F.sequence
    monkeypatch.setattr(portfolio.F, "sequence", lambda a, b: asked.append(b) or sequence(a, b))
    for name, value in {"FIXED": 0, "STEPS": 0, "TASK": 100, "PART": 150}.items():
        monkeypatch.setattr(portfolio, name, value, raising=False)
    found = portfolio.search(spark.createDataFrame(rows, "ts_code string, trade_date date, log_return double"), 20, 3)
    assert len(asked) == (odd > 0) and all("CASE" in str(b) for b in asked)  # before: tiles of all codes, in pairs
    wide = pd.DataFrame(rows, columns=["c", "d", "r"]).pivot(index="d", columns="c", values="r")
    hashes = {r["c"]: r["h"] for r in spark.createDataFrame([(c,) for c in wide], "c string").selectExpr("c", "xxhash64(c) AS h").collect()}
    w = portfolio.draw_weights(np.array([hashes[c] for c in wide], np.int64).view(np.uint64), np.arange(20), 3)
    got = found.orderBy("draw").toPandas()
    np.testing.assert_allclose(got["risk"], np.einsum("di,ij,dj->d", w, wide.cov(min_periods=2).fillna(0).to_numpy(), w, optimize=True) * 252, rtol=1e-9)
    np.testing.assert_allclose(got["gain"], w @ wide.mean().to_numpy() * 252, rtol=1e-9)
