import datetime as dt
import itertools
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from barsmith.operators import prepare, screen, stocks
from barsmith.plans import features
from barsmith.sources import bars as source
from barsmith.streaming import bars as streams

ROOT = Path(__file__).resolve().parents[1]


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for code in ("X", "Y"):
        price = np.cumsum(rng.normal(size=120)) + 100
        for i in range(120):
            o, c = price[i] + rng.normal() * 0.2, price[i] + rng.normal() * 0.2
            rows.append((code, day(i), float(o), float(max(o, c) + rng.random()), float(min(o, c) - rng.random()), float(c), float(rng.integers(1000, 99999)), 1.0))
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, vol double, amount double").cache()


def test_read_and_write(spark, bars, tmp_path):
    for fmt in ("parquet", "csv", "orc"):
        path = str(tmp_path / fmt)
        (bars.write.option("header", True).csv(path) if fmt == "csv" else source.write(bars, path, fmt=fmt))
        got = source.read(spark, path, fmt, codes=["X"])
        assert got.count() == 120 and dict(got.dtypes)["trade_date"] == "date" and dict(got.dtypes)["close"] == "double"
    with pytest.raises(ValueError):
        source.read(spark, "x", "xlsx")


def test_filter_and_columns_reach_the_scan(spark, bars, tmp_path):
    path = str(tmp_path / "p")
    source.write(bars, path)
    plan = source.read(spark, path, columns=["ts_code", "close"], codes=["X"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts_code), EqualTo(ts_code,X)]" in plan or "In(ts_code" in plan
    assert "high" not in plan.split("ReadSchema")[1]


def test_upsert_keeps_the_new(spark, bars):
    new = bars.where("trade_date >= date'2024-03-01'").selectExpr("ts_code", "trade_date", "close + 1 AS close")
    out = source.upsert(bars.select("ts_code", "trade_date", "close"), new)
    assert out.count() == 240
    assert out.join(new, ["ts_code", "trade_date", "close"]).count() == new.count()


def test_fetch_plan_and_ranges():
    d = dt.date
    assert source.fetch_window(None, d(2024, 5, 1), d(2020, 1, 1)) == ("full", d(2020, 1, 1))
    assert source.fetch_window(d(2024, 5, 1), d(2024, 5, 1), d(2020, 1, 1)) == ("skip", None)
    assert source.fetch_window(d(2024, 4, 20), d(2024, 5, 1), d(2020, 1, 1)) == ("incremental", d(2024, 4, 15))
    parts = source.date_ranges(d(2019, 6, 1), d(2026, 2, 3), 5)
    assert parts == [(d(2019, 6, 1), d(2023, 12, 31)), (d(2024, 1, 1), d(2026, 2, 3))]


def test_densify_and_fill(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 3.0), ("b", day(1), 5.0)], "ts_code string, trade_date date, close double")
    dense = source.densify(df)
    assert dense.count() == 6
    filled = prepare.fill_forward(dense, ["close"]).orderBy("ts_code", "trade_date").toPandas()["close"]
    np.testing.assert_array_equal(filled, [1, 1, 3, np.nan, 5, 5])
    line = prepare.interpolate(dense).orderBy("ts_code", "trade_date").toPandas()["close"]
    np.testing.assert_array_equal(line, [1, 2, 3, np.nan, 5, 5])


def test_keep_last_takes_the_last(spark):
    df = spark.createDataFrame([("a", day(0), 1.0, 1), ("a", day(0), 2.0, 2), (None, day(0), 3.0, 3)], "ts_code string, trade_date date, close double, seq int")
    assert [r["close"] for r in prepare.keep_last(prepare.drop_null_keys(df), "seq").collect()] == [2.0]


def best_by_supports(cov):
    """Long-only weights of least variance: the best of all sets of held codes."""
    best = (math.inf, None)
    for k in range(1, len(cov) + 1):
        for held in map(list, itertools.combinations(range(len(cov)), k)):
            x = np.linalg.solve(cov[np.ix_(held, held)], np.ones(k))
            w = np.zeros(len(cov))
            w[held] = x / x.sum()
            if (w >= 0).all() and w @ cov @ w < best[0]:
                best = (w @ cov @ w, w)
    return best[1]


@pytest.mark.parametrize("seed", range(4))
def test_weights(seed):
    rng = np.random.default_rng(seed)
    days = rng.normal(size=(300, 6)) * [1, 2, 3, 4, 5, 6] + seed * rng.normal(size=(300, 1))
    cov = np.cov(days, rowvar=False)
    product = prepare.Covariance(days)
    np.testing.assert_allclose(product @ np.arange(6.0), cov @ np.arange(6.0), rtol=1e-10)
    start = np.full(6, 1 / 6)
    for s in (None, start):
        np.testing.assert_allclose(prepare.min_variance_weights(product, s), best_by_supports(cov), atol=1e-12)
        e = prepare.equal_risk_weights(product, s)
        np.testing.assert_allclose(e * (cov @ e) / (e @ cov @ e), 1 / 6, atol=1e-10)
        assert abs(e.sum() - 1) < 1e-12


def test_more_codes_than_days():
    """The covariance has no inverse: the weights are still feasible and no feasible direction lowers the variance."""
    days = np.random.default_rng(7).normal(size=(20, 60)) + 0.5 * np.random.default_rng(8).normal(size=(20, 1))
    cov = np.cov(days, rowvar=False)
    w = prepare.min_variance_weights(prepare.Covariance(days))
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    slope = cov @ w
    assert slope.min() >= w @ slope - 1e-6


def benchmark_by_hand(rows, window, share, pick):
    """rows: day -> code -> return; weights at month ends from the last rows, held until the next."""
    days = sorted(rows)
    out, held = {}, None
    for i, d in enumerate(days):
        out[d] = sum(held.get(c, 0) * r for c, r in rows[d].items()) if held else 0.0
        if (i + 1 == len(days) or days[i + 1].month != d.month) and min(i + 1, window) >= share * window:
            part = days[max(0, i + 1 - window) : i + 1]
            codes = sorted({c for p in part for c in rows[p]})
            x = np.array([[rows[p].get(c, 0.0) for c in codes] for p in part])
            held = dict(zip(codes, pick(np.atleast_2d(np.cov(x, rowvar=False)))))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 12])
def test_optimised_benchmark(spark, chunk, monkeypatch):
    """Any dealing of rebalance dates gives the benchmark of a plain loop; one code comes late, one goes early."""
    rng = np.random.default_rng(3)
    days = [day(i) for i in range(200)]
    rows = {d: {c: float(v) for c, v in zip("ABCD", rng.normal(size=4) * [1, 2, 0.7, 1.5]) if not (c == "C" and i < 90) and not (c == "D" and i > 110)} for i, d in enumerate(days)}
    panel = spark.createDataFrame([(c, d, None if r > 2.5 else r) for d, v in rows.items() for c, r in v.items()], "ts_code string, trade_date date, log_return double")
    plain = {d: {c: 0.0 if r > 2.5 else r for c, r in v.items()} for d, v in rows.items()}
    monkeypatch.setattr(prepare, "CHUNK", chunk)
    got = {r["trade_date"]: r["benchmark"] for r in prepare.optimised_benchmark(panel, "min_var", 40, 0.8).collect()}
    want = benchmark_by_hand(plain, 40, 0.8, best_by_supports)
    assert set(got) == set(want) and max(abs(got[d] - want[d]) for d in got) < 1e-9 and any(want.values())


def a_points(df, r):
    """The A rules of one code, row by row."""
    c, h = df["close"], df["high"]
    ma = {n: c.rolling(n).mean() for n in (*r["shorts"], r["long"], r["confirm_ma"])}
    over = lambda x, m: (x > m) & ~(x.shift(1) > m.shift(1))
    falling = ma[r["long"]].shift(1) < ma[r["long"]].shift(1 + r["fall"])
    cross = {s: over(ma[s], ma[r["long"]]) for s in r["shorts"]}
    turn = pd.concat(cross.values(), axis=1).any(axis=1)
    for s in r["shorts"]:
        turn &= cross[s].rolling(r["cross_within"], min_periods=1).max().astype(bool) & (ma[s] > ma[r["long"]])
    hit = over(h, ma[r["confirm_ma"]]).astype(int)
    confirm = hit.shift(1).rolling(r["confirm_rows"]).sum() >= 1
    return falling & turn & confirm


def test_a_screen_against_row_by_row(bars):
    rules = screen.A_RULES | {"long": 20, "fall": 5, "shorts": (3, 5), "confirm_rows": 6, "confirm_ma": 8}
    got = screen.points(bars, rules).select("ts_code", "trade_date", "a_point", "b_point", "c_point").toPandas().sort_values(["ts_code", "trade_date"])
    for code, one in bars.toPandas().sort_values("trade_date").groupby("ts_code"):
        want = a_points(one.reset_index(drop=True), rules)
        np.testing.assert_array_equal(got[got.ts_code == code]["a_point"].to_numpy(), want.to_numpy())
    assert got.notna().all().all()


def rising(v, days, up=True):
    """Row by row: whether the last so many steps all went one way."""
    step = [False] + [bool(b > a if up else b < a) for a, b in zip(v, v[1:])]
    return [days <= 0 or (i + 1 >= days and all(step[i + 1 - days : i + 1])) for i in range(len(v))]


def b_and_c_points(one, a, b, c, long):
    """Rules of B and C of one code, row by row, over its A points."""
    n, ma = len(one), lambda x, k: one[x].rolling(k).mean()
    seg, start, b_out, c_out, last_b = 0, 0, [], [], None
    mas, mal = ma("close", b["short"]), ma("close", long)
    dry_s, dry_l, top = ma("vol", b["dry_short"]), ma("vol", b["dry_long"]), one["vol"].shift(1).rolling(a["surge_rows"], min_periods=1).max()
    prev = one["close"].shift(1)
    tr = np.fmax(one["high"] - one["low"], np.fmax((one["high"] - prev).abs(), (one["low"] - prev).abs()))
    atr = tr.rolling(b["atr_rows"]).mean()
    over = (mas >= mal).tolist()
    down = rising(one["vol"].tolist(), b["dry_falling_days"], up=False)
    dry = []
    for t in range(n):
        x = one.iloc[t]
        ok = (not b["use_dry_ratio"] or dry_s[t] <= b["dry_ratio"] * dry_l[t]) and (not b["use_dry_vol"] or x.vol <= dry_l[t]) and (not b["use_dry_means"] or dry_s[t] <= dry_l[t])
        dry.append(bool(ok and (not b["use_dry_falling"] or down[t]) and (not b["use_dry_surge"] or x.vol / top[t] <= b["dry_surge_max"])))
    vma_s, vma_l, ctop, trend, up = ma("vol", c["vma_short"]), ma("vol", c["vma_long"]), one["vol"].shift(1).rolling(c["surge_rows"], min_periods=1).max(), ma("close", c["trend_ma"]), rising(one["vol"].tolist(), c["rising_days"] - 1)
    for t in range(n):
        x = one.iloc[t]
        if x.a_point:
            seg, start = seg + 1, t
        days = t - start
        since = over[start + 1 : t]
        run = 0
        while run < t - start and over[t - 1 - run]:
            run += 1
        above = {"count": sum(since) >= b["above_at_least"] and (b["below_at_most"] is None or max(0, days - 1) - sum(since) <= b["below_at_most"]), "ratio": days > 0 and sum(over[start + 1 : t + 1]) / days >= b["above_ratio"], "run": run >= b["above_at_least"]}[b["above"]]
        low = one["low"][t - 1] if t > start else np.nan
        stable = x.low >= {"ratio": (1 - b["stable"]) * low, "low": low, "atr": low - b["atr_buffer"] * atr[t]}[b["stable_mode"]]
        touch = x[b["touch"]] < mal[t] if b["touch_strict"] else x[b["touch"]] <= mal[t]
        quiet = sum(dry[max(0, t + 1 - b["dry_window"]) : t + 1]) >= b["dry_recent"] if b["dry_recent"] else dry[t]
        point = seg > 0 and b["min_days"] <= days and (b["max_days"] is None or days <= b["max_days"]) and above and (not b["use_touch"] or touch) and (not b["use_vr1"] or x.vol / top[t] <= b["vr1_max"]) and quiet and stable
        volume = (not c["use_surge"] or x.vol >= c["surge"] * ctop[t]) and (not c["use_compare"] or vma_s[t] > vma_l[t]) and (not c["use_rising"] or up[t])
        high = x[c["trend_price"]] > trend[t] if c["trend_strict"] else x[c["trend_price"]] >= trend[t]
        c_out.append(bool(last_b is not None and 1 <= t - last_b <= c["max_days"] and volume and high))
        b_out.append(bool(point))
        if point:
            last_b = t
    return b_out, c_out


@pytest.mark.parametrize("name", ["plain", *screen.VARIANTS])
def test_b_and_c_screens_against_row_by_row(bars, name):
    extra = screen.VARIANTS.get(name, ({}, {}, {}))
    a, b, c = (d | s | e for d, s, e in zip((screen.A_RULES, screen.B_RULES, screen.C_RULES), screen.SHORT, extra))
    loose = a | {"use_falling": False, "use_confirm": False, "require_all": False}  # more segments
    marked = screen.points(bars, loose, b, c).toPandas().sort_values(["ts_code", "trade_date"])
    hits = 0
    for _, one in marked.groupby("ts_code"):
        one = one.reset_index(drop=True)
        want_b, want_c = b_and_c_points(one, loose, b, c, a["long"])
        assert one["b_point"].tolist() == want_b and one["c_point"].tolist() == want_c
        hits += sum(want_b)
    assert hits and marked["a_point"].sum() > 2


def test_segments_do_not_mix_codes(bars):
    marked = screen.points(bars, *screen.SHORT)
    assert marked.where("segment = 0 and b_point").count() == 0
    s = screen.summary(marked).toPandas()
    assert set(s.ts_code) == {"X", "Y"} and (s.n_b >= 0).all()
    assert screen.explain_a(marked).where("a_point and why = ''").count() == 0


def test_stock_queries(spark):
    df = spark.createDataFrame([("000001", "Alpha Bank", "Main", "Bank"), ("000002", "Beta", "Growth", "Tech"), ("000003", None, None, "Tech")], "symbol string, name string, market string, industry string")
    assert stocks.find(df, name="alpha bonk").count() == 1 and stocks.find(df, name="alpha bonk", fuzzy=False).count() == 0
    p = stocks.page(stocks.find(df, industry="TECH"), 1, 1, "market", True).collect()
    assert len(p) == 1 and p[0]["total"] == 2 and p[0]["symbol"] == "000002"


def test_features(spark, bars):
    panel = source.with_returns(bars)
    wide = features.assemble(panel, ("RSI", "BIAS"), (3, 5))
    assert {"RSI_3", "BIAS_5"} <= set(wide.columns) and wide.count() == 240
    scaled = features.scale(features.impute(wide, ["RSI_3"]), ["RSI_3"], "minmax").agg({"RSI_3": "max"}).first()[0]
    assert abs(scaled - 1) < 1e-12
    train, test = features.split(wide, "2024-02-29", "2024-03-01", "2024-03-31")
    assert train.where("trade_date > '2024-02-29'").count() == 0 and test.count() == 62
    replayed = features.replay(panel.selectExpr("ts_code", "trade_date", "close", "1.0D AS action"))
    stats = features.episode_stats(replayed).collect()
    assert len(stats) == 2


def test_optimal_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.1)], "label int, score double")
    r = features.optimal_threshold(df).first()
    assert r["threshold"] == 0.6 and abs(r["f1"] - 6 / 7) < 1e-12


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", day(i), float(i + 1)) for i in range(4)]
    schema = "ts_code string, trade_date date, close double"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(path)
    stream = streams.moving_ema(spark.readStream.schema(schema).parquet(path), 3)
    q = stream.writeStream.format("memory").queryName("ema_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = [r["ema"] for r in spark.table("ema_out").orderBy("trade_date").collect()]
    finally:
        q.stop()
    assert got == [1.0, 1.5, 2.25, 3.125]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_the_rest_does_not_need_the_corpus_part():
    found = subprocess.run(["grep", "-rlE", r"barsmith\.llm|corpus_pipeline", str(ROOT / "barsmith"), "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/llm/" in f for f in found)
    code = "import sys; sys.modules['barsmith.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
