"""Preparation of raw bars: duplicates, history and liquidity filters, filling, winsorising, benchmarks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY
from barsmith.plans.staged import rounded, shown
from barsmith.sources import bars as source
from barsmith.sources import stored


def drop_null_keys(bars: DataFrame) -> DataFrame:
    return bars.dropna(subset=[KEY, DATE])


def keep_last(bars: DataFrame, order: str) -> DataFrame:
    """One row for each code and date: the one that an order column puts last."""
    last = Window.partitionBy(KEY, DATE).orderBy(F.desc(order))
    return bars.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def min_history(bars: DataFrame, rows: int = 500) -> DataFrame:
    """Codes with so many bars at least."""
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy(KEY))).where(F.col("_n") >= rows).drop("_n")


def liquid_codes(bars: DataFrame, days: int = 500, share: float = 0.9, tile: float = 0.25) -> DataFrame:
    """(ts_code): of the last so many calendar days, codes with share of the most days and a mean amount over a percentile of all."""
    last = bars.agg(F.max(DATE).alias("_last"))
    recent = bars.join(F.broadcast(last)).where(F.col(DATE) >= F.date_sub("_last", days))
    by_code = recent.groupBy(KEY).agg(F.countDistinct(DATE).alias("n"), F.avg("amount").alias("mean_amount"))
    limit = by_code.agg((F.max("n") * share).alias("least"), F.expr(f"percentile(mean_amount, {tile})").alias("floor"))
    return by_code.join(F.broadcast(limit)).where("n >= least and mean_amount > floor").select(KEY)


def keep_codes(bars: DataFrame, codes: DataFrame) -> DataFrame:
    return bars.join(codes, KEY, "left_semi")


def drop_zero_close(bars: DataFrame) -> DataFrame:
    return bars.where("close <> 0")


def until(bars: DataFrame, day: str) -> DataFrame:
    """Bars up to a day, which is passed in so that reruns agree."""
    return bars.where(F.col(DATE) <= F.lit(day).cast("date"))


def survivors(bars: DataFrame, column: str = "close", days: int = 10) -> DataFrame:
    """Bars of codes that still have a value within so many days of the last date."""
    last = bars.agg(F.max(DATE).alias("_last"))
    codes = bars.where(F.col(column).isNotNull()).groupBy(KEY).agg(F.max(DATE).alias("_seen")).join(F.broadcast(last)).where(F.col("_seen") >= F.date_sub("_last", days))
    return keep_codes(bars, codes.select(KEY))


def common_start(bars: DataFrame, column: str = "close") -> DataFrame:
    """Rows from the latest of the codes' first days with a value on."""
    first = bars.where(F.col(column).isNotNull()).groupBy(KEY).agg(F.min(DATE).alias("_first")).agg(F.max("_first").alias("_start"))
    return bars.join(F.broadcast(first)).where(F.col(DATE) >= F.col("_start")).drop("_start")


def common_end(bars: DataFrame, column: str = "close") -> DataFrame:
    """Rows up to the earliest of the codes' last days with a value."""
    last = bars.where(F.col(column).isNotNull()).groupBy(KEY).agg(F.max(DATE).alias("_last")).agg(F.min("_last").alias("_end"))
    return bars.join(F.broadcast(last)).where(F.col(DATE) <= F.col("_end")).drop("_end")


def pct_change(x: str, n: int = 1) -> str:
    """Change over n rows of a series whose gaps are filled forward first, as an expression over a column <x>_filled."""
    return f"{x}_filled / nullif(lag({x}_filled, {n}) OVER (PARTITION BY {KEY} ORDER BY {DATE}), 0) - 1"


def fill_forward(panel: DataFrame, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(DATE)
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_panel(panel: DataFrame) -> DataFrame:
    """Prices, volume and amount forward; returns 0 from a code's first on."""
    filled = fill_forward(panel, ["open", "high", "low", "close", "vol", "amount"])
    begun = F.count("log_return").over(Window.partitionBy(KEY).orderBy(DATE)) > 0
    return filled.withColumn("log_return", F.when(begun, F.coalesce("log_return", F.lit(0e0))))


def winsorize(panel: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Values of each date clipped to its percentiles."""
    out = panel
    for c in columns:
        lo, hi = (f"percentile({c}, {q}) OVER (PARTITION BY {DATE})" for q in (lower, upper))
        out = out.withColumn(c, F.expr(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {hi}), {lo}) END"))
    return out


def expand_daily(series: DataFrame, code: str = KEY, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Each series on all calendar days between its first and last, filled forward."""
    span = series.groupBy(code).agg(F.min(DATE).alias("a"), F.max(DATE).alias("b"))
    days = span.select(code, F.explode(F.sequence("a", "b")).alias(DATE))
    w = Window.partitionBy(code).orderBy(DATE)
    return days.join(series, [code, DATE], "left").withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def interpolate(series: DataFrame, column: str = "close", code: str = KEY) -> DataFrame:
    """Gaps between two values on a straight line in time; after the last the last stays."""
    back, on = Window.partitionBy(code).orderBy(DATE), Window.partitionBy(code).orderBy(DATE).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(column).isNotNull(), F.struct(F.col(DATE).alias("d"), F.col(column).alias("v")))
    out = series.withColumn("_a", F.last(point, ignorenulls=True).over(back)).withColumn("_b", F.first(point, ignorenulls=True).over(on))
    line = F.expr(f"_a.v + (_b.v - _a.v) * datediff({DATE}, _a.d) / nullif(datediff(_b.d, _a.d), 0)")
    return out.withColumn(column, F.coalesce(column, line, F.col("_a.v"))).drop("_a", "_b")


def clean_series(series: DataFrame, since: str = "2015-01-01") -> DataFrame:
    """Series that begin before a day."""
    first = series.where("close is not null").groupBy(KEY).agg(F.min(DATE).alias("f")).where(F.col("f") < F.lit(since).cast("date"))
    return keep_codes(series, first.select(KEY))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if counts[c]))


# --- benchmarks --------------------------------------------------------------------------------------------------


def equal_weight_benchmark(panel: DataFrame) -> DataFrame:
    """(trade_date, benchmark): sum of returns over the number of codes; a missing return adds nothing."""
    n = panel.select(KEY).distinct().agg(F.count("*").alias("_n"))
    return panel.groupBy(DATE).agg(F.sum("log_return").alias("_s")).join(F.broadcast(n)).select(DATE, (F.col("_s") / F.col("_n")).alias("benchmark"))


def with_benchmark(panel: DataFrame, benchmark: DataFrame) -> DataFrame:
    """panel with one benchmark value a date (a row a trading date: small enough to send everywhere)."""
    return panel.join(F.broadcast(benchmark), DATE, "left")


def mark_equal_weight(panel: DataFrame) -> DataFrame:
    """A dense panel with its equal-weight benchmark beside each row: a date's rows are its codes, so no second panel is built."""
    w = Window.partitionBy(DATE)
    return panel.withColumn("benchmark", F.sum("log_return").over(w) / F.count("*").over(w))


def rebalance_dates(panel: DataFrame) -> DataFrame:
    """(month_end): last trading date of each month."""
    return panel.groupBy(F.last_day(DATE).alias("_m")).agg(F.max(DATE).alias("month_end")).select("month_end")


def _to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    cut = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - cut[np.flatnonzero(u > cut)[-1]], 0)


class Covariance:
    """The covariance of the columns of a matrix of days, which is never laid out: its products with weights are
    products with the days, so memory and time grow with the number of codes and not with its square."""

    def __init__(self, days: np.ndarray):
        self.x = (days - days.mean(axis=0)) / np.sqrt(max(len(days) - 1, 1))
        self.n = self.x.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.x.T @ (self.x @ w)

    def variances(self) -> np.ndarray:
        return (self.x * self.x).sum(axis=0)

    def largest(self) -> float:
        return float(np.linalg.norm(self.x, 2)) ** 2

    def part(self, chosen: np.ndarray) -> np.ndarray:
        return self.x[:, chosen].T @ self.x[:, chosen]


def min_variance_weights(cov: Covariance, start: np.ndarray | None = None, steps: int = 5000, tolerance: float = 1e-12) -> np.ndarray:
    """Long-only weights of least variance: accelerated projected gradients find the codes that are held, and one linear
    system over those (where it has one solution) the weights themselves."""
    w = y = np.full(cov.n, 1 / cov.n) if start is None else start
    rate, t = 1 / max(2 * cov.largest(), 1e-300), 1e0
    for _ in range(steps):
        new = _to_simplex(y - rate * 2 * (cov @ y))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max() < tolerance
        w, t = new, t_new
        if done:
            break
    held = np.flatnonzero(w > 1e-9)
    if len(held) < len(cov.x):
        exact = np.linalg.lstsq(cov.part(held), np.ones(len(held)), rcond=None)[0]
        if exact.sum() > 0 and (exact >= 0).all() and np.abs(exact / exact.sum() - w[held]).max() < 1e-4:
            w = np.zeros(cov.n)
            w[held] = exact / exact.sum()
    return w


def equal_risk_weights(cov: Covariance, start: np.ndarray | None = None, steps: int = 2000, tolerance: float = 1e-14) -> np.ndarray:
    """Weights whose risk contributions are equal, by cyclic coordinate descent on the log-barrier form."""
    size = cov.variances()
    w = 1 / np.sqrt(np.maximum(size, 1e-300)) if start is None else start / np.sqrt(max(start @ (cov @ start), 1e-300))
    own = cov.x @ w
    for _ in range(steps):
        old = w.copy()
        for i in np.flatnonzero(size > 0):
            b = cov.x[:, i] @ own - size[i] * w[i]
            new = (-b + np.sqrt(b * b + 4 * size[i] / cov.n)) / (2 * size[i])
            own += cov.x[:, i] * (new - w[i])
            w[i] = new
        if np.abs(w - old).max() < tolerance * np.abs(w).max():
            break
        own = cov.x @ w
    return w / w.sum()


#: Rebalance dates that one task works through, each from the weights of the one before.
CHUNK = 12


def optimised_benchmark(panel: DataFrame, method: str = "min_var", window: int = 252, share: float = 0.8, days: list | None = None) -> DataFrame:
    """(trade_date, benchmark): weights set at each month's last date from the covariance of the last rows hold from
    the next date on; before the first it is 0.

    Bars are dealt once to runs of CHUNK rebalance dates with the window before the first of them: about two copies of
    a bar, not one for each window that holds it.  A task holds these rows of all codes, some 4 KB a code, and no
    matrix of codes by codes.  days is the panel's calendar, worked out if not given."""
    spark = panel.sparkSession
    solve = {"min_var": min_variance_weights, "erc": equal_risk_weights}[method]
    days = source.trading_days(panel) if days is None else days
    ends = [i for i, d in enumerate(days) if i + 1 == len(days) or (d.year, d.month) != (days[i + 1].year, days[i + 1].month)]
    ends = [i for i in ends if min(i + 1, window) >= share * window]
    if not ends:
        return spark.createDataFrame([(d, 0.0) for d in days], f"{DATE} date, benchmark double")
    runs = [ends[i : i + CHUNK] for i in range(0, len(ends), CHUNK)]
    until = [run[0] for run in runs[1:]] + [len(days) - 1]
    places = [(d, i, [c for c, run in enumerate(runs) if run[0] - window < i <= until[c]]) for i, d in enumerate(days)]
    known = F.broadcast(spark.createDataFrame(places, f"{DATE} date, no int, runs array<int>"))  # a row a trading date
    rows = panel.select(KEY, DATE, F.coalesce("log_return", F.lit(0e0)).alias("r")).join(known, DATE).select(KEY, "no", "r", F.explode("runs").alias("run"))

    def each(t: pa.Table) -> pa.Table:
        run, no = t.column("run")[0].as_py(), t.column("no").to_numpy()
        codes = t.column(KEY).combine_chunks().dictionary_encode()
        first, last = max(0, runs[run][0] - window + 1), until[run]
        x, there = np.zeros((last - first + 1, len(codes.dictionary))), np.zeros((last - first + 1, len(codes.dictionary)), bool)
        at = no - first, codes.indices.to_numpy()
        x[at], there[at] = t.column("r").to_numpy(), True
        made, before = np.zeros(last - first + 1), None
        for k, end in enumerate(runs[run]):
            part = slice(max(0, end - window + 1) - first, end + 1 - first)
            held = np.flatnonzero(there[part].any(axis=0))
            start = None if before is None or not before[held].all() else before[held] / before[held].sum()
            w = np.zeros(x.shape[1])
            w[held] = solve(Covariance(x[part][:, held]), start)
            before = w
            stop = runs[run][k + 1] if k + 1 < len(runs[run]) else last
            made[end + 1 - first : stop + 1 - first] = x[end + 1 - first : stop + 1 - first] @ w
        own = np.arange(runs[run][0] + 1, last + 1)
        return pa.table([pa.array([days[i] for i in own], pa.date32()), pa.array(made[own - first])], names=[DATE, "made"])

    made = rows.groupBy("run").applyInArrow(each, f"{DATE} date, made double")
    return known.select(DATE).join(made, DATE, "left").select(DATE, F.coalesce("made", F.lit(0e0)).alias("benchmark"))


def pipeline(bars: DataFrame, start: str | None = None) -> DataFrame:
    """Common start, survivors, dense panel, filling, winsorised volume, amount and return."""
    rows = survivors(common_start(source.with_returns(drop_null_keys(bars))))
    if start:
        rows = rows.where(F.col(DATE) >= F.lit(start).cast("date"))
    return winsorize(fill_panel(source.densify(rows)), ["vol", "amount", "log_return"])


# --- queries -----------------------------------------------------------------------------------------------------

_R = lambda c, n=6: f"{rounded(c, n)} AS {c}"
_S = lambda c, n=6: f"{shown(c, n)} AS {c}"


def _duplicated(s, d):
    """Events as raw ticks of one code and day, of which the last counts."""
    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.selectExpr(f"concat('U', lpad(cast(user_id as string), 6, '0')) AS {KEY}", f"to_date(ts) AS {DATE}", "value AS close", "struct(ts, event_id) AS seq")
    return keep_last(drop_null_keys(rows), "seq").selectExpr(KEY, DATE, _S("close"))


def _filled(s, d):
    return fill_panel(source.panel(s, d)).selectExpr(KEY, DATE, *(_S(c) for c in ("close", "vol", "log_return")))


def _winsorized(s, d):
    return winsorize(source.panel(s, d), ["vol", "amount", "log_return"]).selectExpr(KEY, DATE, *(_S(c) for c in ("vol", "amount", "log_return")))


def _upserted(s, d):
    b = source.events_bars(s, d)
    old, new = b.where(F.col(DATE) <= "2024-01-20"), b.where(F.col(DATE) >= "2024-01-15").withColumn("close", F.col("close") + 1)
    return source.upsert(old, new).selectExpr(KEY, DATE, _S("close"))


def _optimised(s, d, method):
    days = source.trading_days(s.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias(DATE)))
    return optimised_benchmark(source.panel(s, d, "lineitem"), method, days=days).selectExpr(DATE, _S("benchmark", 6))


def _members(s, d):
    """Bars up to a day, without zero closes, of the codes that are traded enough."""
    b = source.events_bars(s, d)
    return keep_codes(until(drop_zero_close(b), "2024-01-25"), liquid_codes(b, 20)).selectExpr(KEY, DATE, _S("close"))


def _coerced(s, d):
    """Orders as a vendor's table: other names, numbers as text of which some are none, days as text."""
    raw = s.read.parquet(f"{d}/orders.parquet").selectExpr("concat('C', o_custkey % 50) AS symbol", "cast(to_date(o_orderdate) as string) AS day", "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN 'NaN' ELSE cast(o_totalprice as string) END AS price", "CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE cast(o_orderkey as string) END AS number", "cast(null as string) AS nothing")
    made = source.normalise(raw, {"symbol": KEY, "day": DATE, "price": "close", "number": "vol"})
    return drop_empty_columns(made).selectExpr(KEY, DATE, _S("close"), _S("vol"))


def _fetch_plan(s, d):
    """What a fetch up to 2024-01-28 has to ask for: codes of all users, of which the odd ones are stored to the 20th, others in part."""
    b = source.events_bars(s, d).selectExpr(KEY, DATE, f"cast(substr({KEY}, 2) as int) % 3 AS k")
    held = stored.summarise(b.where(f"k = 0 OR k = 1 AND {DATE} <= '2024-01-20'"))
    return stored.fetch_plan(b, held, "2024-01-28", "2024-01-05", 5)


_P = source.panel_sql()
_SO_FAR = f"PARTITION BY {KEY} ORDER BY {DATE} ROWS UNBOUNDED PRECEDING"
_CLIPPED = lambda c: f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, quantile_cont({c}, 0.99) OVER (PARTITION BY {DATE})), quantile_cont({c}, 0.01) OVER (PARTITION BY {DATE})) END AS {c}"
_PIPELINE_SQL = f"""WITH {source.EVENTS_BARS}, r AS (SELECT *, lag(close) OVER (PARTITION BY {KEY} ORDER BY {DATE}) AS p FROM bars WHERE {KEY} IS NOT NULL AND {DATE} IS NOT NULL),
c AS (SELECT *, CASE WHEN close > 0 AND p > 0 THEN ln(close / p) END AS log_return FROM r WHERE {DATE} >= (SELECT max(f) FROM (SELECT min({DATE}) AS f FROM r WHERE close IS NOT NULL GROUP BY {KEY}))),
k AS (SELECT {KEY} FROM c WHERE close IS NOT NULL GROUP BY {KEY} HAVING max({DATE}) >= (SELECT max({DATE}) FROM c) - 10), s AS (SELECT c.* FROM c SEMI JOIN k USING ({KEY})),
g AS (SELECT a.{KEY}, d.{DATE}, close, vol, amount, log_return FROM (SELECT DISTINCT {KEY} FROM s) a CROSS JOIN (SELECT DISTINCT {DATE} FROM s) d LEFT JOIN s ON s.{KEY} = a.{KEY} AND s.{DATE} = d.{DATE}),
f AS (SELECT {KEY}, {DATE}, {', '.join(f'last_value({c} IGNORE NULLS) OVER ({_SO_FAR}) AS {c}' for c in ('close', 'vol', 'amount'))}, CASE WHEN count(log_return) OVER ({_SO_FAR}) > 0 THEN coalesce(log_return, 0e0) END AS log_return FROM g),
w AS (SELECT {KEY}, {DATE}, close, {', '.join(map(_CLIPPED, ('vol', 'amount', 'log_return')))} FROM f) SELECT {KEY}, {DATE}, {', '.join(_R(c) for c in ('close', 'vol', 'amount', 'log_return'))} FROM w"""
_LINE_SQL = f"""WITH {_P}, a AS (SELECT {KEY}, {DATE}, close, max(CASE WHEN close IS NOT NULL THEN {DATE} END) OVER ({_SO_FAR}) AS a_day, min(CASE WHEN close IS NOT NULL THEN {DATE} END) OVER (PARTITION BY {KEY} ORDER BY {DATE} DESC ROWS UNBOUNDED PRECEDING) AS b_day FROM panel),
l AS (SELECT x.{KEY}, x.{DATE}, coalesce(x.close, p.close + (n.close - p.close) * (x.{DATE} - a_day) / nullif(b_day - a_day, 0), p.close) AS close FROM a x LEFT JOIN panel p ON p.{KEY} = x.{KEY} AND p.{DATE} = a_day LEFT JOIN panel n ON n.{KEY} = x.{KEY} AND n.{DATE} = b_day)
SELECT {KEY}, {DATE}, {_R('close')} FROM l"""
#: Three codes, so that weights of least variance are the best of seven formulas, and equal risks a short recursion.
_THREE = f"""WITH RECURSIVE {source.panel_sql('lineitem')}, d AS (SELECT {DATE}, row_number() OVER (ORDER BY {DATE}) AS no FROM (SELECT DISTINCT {DATE} FROM panel)),
x AS (SELECT {DATE}, no, {', '.join(f"coalesce(sum(CASE WHEN {KEY} = '{c}' THEN log_return END), 0) AS r{i}" for i, c in enumerate('ANR', 1))} FROM panel JOIN d USING ({DATE}) GROUP BY ALL),
e AS (SELECT max(no) AS end_no FROM d GROUP BY date_trunc('month', {DATE}) HAVING least(max(no), 252) >= 0.8 * 252), w AS (SELECT end_no, lead(end_no) OVER (ORDER BY end_no) AS until FROM e),
c AS (SELECT end_no, until, {', '.join(f'covar_samp(r{i}, r{j}) AS c{i}{j}' for i, j in ((1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3)))} FROM w JOIN x ON no BETWEEN end_no - 251 AND end_no GROUP BY ALL)"""
_HELD = f"""SELECT {DATE}, {_R('coalesce(r1 * w1 + r2 * w2 + r3 * w3, 0)').replace(' AS coalesce(r1 * w1 + r2 * w2 + r3 * w3, 0)', '')} AS benchmark FROM x LEFT JOIN best ON no > end_no AND (until IS NULL OR no <= until)"""
_TWO = lambda i, j: f"(c{j}{j} - c{min(i, j)}{max(i, j)}) / (c{i}{i} + c{j}{j} - 2 * c{min(i, j)}{max(i, j)})"
_TRIPLE = ("(c22 * c33 - c23 * c23) + (c13 * c23 - c12 * c33) + (c12 * c23 - c13 * c22)", "(c13 * c23 - c12 * c33) + (c11 * c33 - c13 * c13) + (c12 * c13 - c11 * c23)", "(c12 * c23 - c13 * c22) + (c12 * c13 - c11 * c23) + (c11 * c22 - c12 * c12)")
_CHOICES = [("1.0", "0.0", "0.0"), ("0.0", "1.0", "0.0"), ("0.0", "0.0", "1.0"), (_TWO(1, 2), _TWO(2, 1), "0.0"), (_TWO(1, 3), "0.0", _TWO(3, 1)), ("0.0", _TWO(2, 3), _TWO(3, 2)), tuple(f"({t}) / ({' + '.join(_TRIPLE)})" for t in _TRIPLE)]
_MIN_VAR_SQL = f"""{_THREE}, v AS ({' UNION ALL '.join(f'SELECT *, {a} AS w1, {b} AS w2, {c} AS w3 FROM c' for a, b, c in _CHOICES)}),
best AS (SELECT * FROM v WHERE w1 >= 0 AND w2 >= 0 AND w3 >= 0 QUALIFY row_number() OVER (PARTITION BY end_no ORDER BY w1 * w1 * c11 + w2 * w2 * c22 + w3 * w3 * c33 + 2 * (w1 * w2 * c12 + w1 * w3 * c13 + w2 * w3 * c23)) = 1) {_HELD}"""
_ROOT = lambda b, a: f"(- ({b}) + sqrt(({b}) * ({b}) + 4 * {a} / 3)) / (2 * {a})"
_ONE = "end_no, until, c11, c22, c33, c12, c13, c23"
_ERC_SQL = f"""{_THREE}, s AS (SELECT {_ONE}, 0 AS k, 1 / sqrt(c11) AS w1, 1 / sqrt(c22) AS w2, 1 / sqrt(c33) AS w3 FROM c UNION ALL
  SELECT {_ONE}, k, w1, w2, {_ROOT('c13 * w1 + c23 * w2', 'c33')} AS w3 FROM (SELECT {_ONE}, k, w1, {_ROOT('c12 * w1 + c23 * w3', 'c22')} AS w2, w3 FROM (SELECT {_ONE}, k + 1 AS k, {_ROOT('c12 * w2 + c13 * w3', 'c11')} AS w1, w2, w3 FROM s WHERE k < 200))),
best AS (SELECT end_no, until, w1 / (w1 + w2 + w3) AS w1, w2 / (w1 + w2 + w3) AS w2, w3 / (w1 + w2 + w3) AS w3 FROM s WHERE k = 200) {_HELD}"""
_FAR = f"PARTITION BY {KEY} ORDER BY {DATE}"
QUERIES = {
    "prep_keep_last": (_duplicated, f"WITH t AS (SELECT 'U' || lpad(user_id::VARCHAR, 6, '0') AS {KEY}, ts::DATE AS {DATE}, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT {KEY}, {DATE}, floor(CAST(value AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS close FROM t WHERE k = 1 AND {KEY} IS NOT NULL"),
    "prep_min_history": (lambda s, d: min_history(source.events_bars(s, d), 27).selectExpr(KEY, DATE, _S("close")), f"WITH {source.EVENTS_BARS} SELECT {KEY}, {DATE}, floor(CAST(close AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS close FROM bars QUALIFY count(*) OVER (PARTITION BY {KEY}) >= 27"),
    "prep_liquid": (lambda s, d: liquid_codes(source.events_bars(s, d), 20), f"WITH {source.EVENTS_BARS}, r AS (SELECT * FROM bars WHERE {DATE} >= (SELECT max({DATE}) FROM bars) - 20), c AS (SELECT {KEY}, count(DISTINCT {DATE}) AS n, avg(amount) AS m FROM r GROUP BY 1) SELECT {KEY} FROM c WHERE n >= (SELECT max(n) FROM c) * 0.9 AND m > (SELECT quantile_cont(m, 0.25) FROM c)"),
    "prep_filled": (_filled, f"WITH {_P}, f AS (SELECT {KEY}, {DATE}, last_value(close IGNORE NULLS) OVER ({_FAR} ROWS UNBOUNDED PRECEDING) AS close, last_value(vol IGNORE NULLS) OVER ({_FAR} ROWS UNBOUNDED PRECEDING) AS vol, CASE WHEN count(log_return) OVER ({_FAR} ROWS UNBOUNDED PRECEDING) > 0 THEN coalesce(log_return, 0e0) END AS log_return FROM panel) SELECT {KEY}, {DATE}, {', '.join(_R(c) for c in ('close', 'vol', 'log_return'))} FROM f"),
    "prep_winsorized": (_winsorized, f"WITH {_P}, f AS (SELECT {KEY}, {DATE}, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, quantile_cont({c}, 0.99) OVER (PARTITION BY {DATE})), quantile_cont({c}, 0.01) OVER (PARTITION BY {DATE})) END AS {c}' for c in ('vol', 'amount', 'log_return'))} FROM panel) SELECT {KEY}, {DATE}, {', '.join(_R(c) for c in ('vol', 'amount', 'log_return'))} FROM f"),
    "prep_survivors": (lambda s, d: survivors(source.lineitem_bars(s, d)).selectExpr(KEY, DATE, _S("close")), f"WITH {source.LINEITEM_BARS} SELECT {KEY}, {DATE}, floor(CAST(close AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS close FROM bars WHERE {KEY} IN (SELECT {KEY} FROM bars GROUP BY 1 HAVING max({DATE}) >= (SELECT max({DATE}) FROM bars) - 10)"),
    "prep_common_start": (lambda s, d: common_start(source.events_bars(s, d)).selectExpr(KEY, DATE, _S("close")), f"WITH {source.EVENTS_BARS} SELECT {KEY}, {DATE}, floor(CAST(close AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS close FROM bars WHERE {DATE} >= (SELECT max(f) FROM (SELECT min({DATE}) AS f FROM bars WHERE close IS NOT NULL GROUP BY {KEY}))"),
    "prep_upsert": (_upserted, f"WITH {source.EVENTS_BARS} SELECT {KEY}, {DATE}, floor(CAST(CASE WHEN {DATE} >= DATE '2024-01-15' THEN close + 1 ELSE close END AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS close FROM bars"),
    "prep_expand_daily": (lambda s, d: expand_daily(source.events_bars(s, d).select(KEY, DATE, "close")).selectExpr(KEY, DATE, _S("close")), f"WITH {source.EVENTS_BARS}, days AS (SELECT {KEY}, unnest(generate_series(min({DATE}), max({DATE}), INTERVAL 1 DAY))::DATE AS {DATE} FROM bars GROUP BY {KEY}) SELECT d.{KEY}, d.{DATE}, floor(CAST(last_value(b.close IGNORE NULLS) OVER (PARTITION BY d.{KEY} ORDER BY d.{DATE} ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS close FROM days d LEFT JOIN bars b ON b.{KEY} = d.{KEY} AND b.{DATE} = d.{DATE}"),
    "benchmark_ew": (lambda s, d: equal_weight_benchmark(source.panel(s, d)).selectExpr(DATE, _S("benchmark", 6)), f"WITH {_P} SELECT {DATE}, floor(CAST(sum(log_return) / (SELECT count(DISTINCT {KEY}) FROM panel) AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS benchmark FROM panel GROUP BY {DATE}"),
    "benchmark_min_var": (lambda s, d: _optimised(s, d, "min_var"), _MIN_VAR_SQL),
    "benchmark_erc": (lambda s, d: _optimised(s, d, "erc"), _ERC_SQL),
    "prep_fetch_plan": (_fetch_plan, f"WITH {source.EVENTS_BARS}, b AS (SELECT *, substr({KEY}, 2)::INT % 3 AS k FROM bars), h AS (SELECT {KEY}, max(CASE WHEN k = 0 OR (k = 1 AND {DATE} <= DATE '2024-01-20') THEN {DATE} END) AS l FROM b GROUP BY 1) SELECT {KEY}, CASE WHEN l IS NULL THEN 'full' WHEN l >= DATE '2024-01-28' THEN 'skip' ELSE 'incremental' END AS what, CASE WHEN l IS NULL THEN DATE '2024-01-05' WHEN l < DATE '2024-01-28' THEN greatest(DATE '2024-01-05', l - 5) END AS since FROM h"),
    "prep_members": (_members, f"WITH {source.EVENTS_BARS}, r AS (SELECT * FROM bars WHERE {DATE} >= (SELECT max({DATE}) FROM bars) - 20), c AS (SELECT {KEY}, count(DISTINCT {DATE}) AS n, avg(amount) AS m FROM r GROUP BY 1), k AS (SELECT {KEY} FROM c WHERE n >= (SELECT max(n) FROM c) * 0.9 AND m > (SELECT quantile_cont(m, 0.25) FROM c)) SELECT {KEY}, {DATE}, {_R('close')} FROM bars SEMI JOIN k USING ({KEY}) WHERE close <> 0 AND {DATE} <= DATE '2024-01-25'"),
    "prep_coerced": (_coerced, f"SELECT 'C' || (o_custkey % 50) AS {KEY}, o_orderdate::DATE AS {DATE}, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN {rounded('o_totalprice')} END AS close, CASE WHEN o_orderkey % 13 <> 0 THEN {rounded('o_orderkey')} END AS vol FROM orders"),
    "prep_pipeline": (lambda s, d: pipeline(source.events_bars(s, d)).selectExpr(KEY, DATE, *(_S(c) for c in ("close", "vol", "amount", "log_return"))), _PIPELINE_SQL),
    "prep_interpolate": (lambda s, d: interpolate(source.densify(source.events_bars(s, d).select(KEY, DATE, "close"))).selectExpr(KEY, DATE, _S("close")), _LINE_SQL),
}
