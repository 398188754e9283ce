"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY
from barsmith.functions.student import two_sided_p_sql
from barsmith.operators import factor, period, prepare, relative, rolling, screen, stocks
from barsmith.plans import evaluation, expression, features, modelling, orders, portfolio
from barsmith.plans.staged import apply, needed, rounded, select, shown, significant, to_sql
from barsmith.sources import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _columns(names, keys=(KEY, DATE)) -> dict:
    return {**{k: k for k in keys}, **{n: significant(n) for n in names}}


# --- bars and panels ---------------------------------------------------------------------------------------------

for _kind in ("events", "lineitem"):
    _names = ["open", "high", "low", "close", "vol", "amount", "log_return"]
    query(f"panel_{_kind}", to_sql(bars.panel_sql(_kind), "panel", [], _columns(_names)))(lambda s, d, k=_kind, n=_names: select(bars.panel(s, d, k), _columns(n)))

# --- rolling indicators ------------------------------------------------------------------------------------------


def _rolling(name: str, kind: str, window: int, metrics: tuple[str, ...]) -> None:
    stages, columns = needed(rolling.stages(window), metrics), _columns(metrics)
    query(name, to_sql(bars.panel_sql(kind), "panel", stages, columns))(lambda s, d: select(apply(bars.panel(s, d, kind), stages), columns))


_rolling("rolling_core", "events", 5, ("CloseMA", "PriceSigma", "BollUp_2", "RSI"))
FAMILIES = {
    "bands": ("CloseMA", "PriceSigma", "CloseMADiff", *(f"Boll{x}_{k}" for x in ("Up", "UpDiff", "Do", "DoDiff", "UpDo") for k in (2, 3))),
    "range": ("L", "H", "RSV", "VolMA", "VolMADiff", "RSI", "MTM", *(f"MTMMA{x}_{k}" for x in ("", "Diff") for k in (3, 6, 10))),
    "volume": ("OBV", "MAOBV", "MAOBVDiff", "PVT", "MAPVT", "MAPVTDiff", "VR", *(f"MAVR{x}_{k}" for x in ("", "Diff") for k in (3, 6, 12))),
    "mood": ("PSY", *(f"MAPSY{x}_{k}" for x in ("", "Diff") for k in (3, 6)), "CCI", "CR", *(f"MACR{x}_{n}" for x in ("", "Diff") for n in ("10_5", "20_9", "40_17", "62_28"))),
    "energy": ("AR", "BR", "BRARDiff", "ARDiff_40", "ARDiff_180", "BRDiff_400", "BRDiff_40", "BIAS", *(f"MABIAS{x}_{n}" for x in ("", "Diff") for n in (5, 10))),
    "trend": ("TR", "PDI", "MDI", "PDIMDIDiff", "ADX_6", "ADXR_6_6", "ADXR_6_14", "ADXRDiff_6_6", "ADXRDiff_6_14", "DKX", "DKXDiff", *(f"MADKX{x}_{n}" for x in ("", "Diff") for n in (5, 10, 15))),
}
for _name, _metrics in FAMILIES.items():
    _rolling(f"rolling_{_name}_5", "events", 5, _metrics)
    _rolling(f"rolling_{_name}_20", "lineitem", 20, _metrics)

_STATE = ("EMA", "EMADiff", "TRIX", "MATRIX_3", "MATRIXDiff_3", "MATRIX_5", "MATRIXDiff_5", "KDJ_K_3", "KDJ_D_3", "KDJ_J_3", "KDJ_KD_3", "KDJ_KJ_3", "KDJ_DJ_3")


def _state_sql(window: int) -> str:
    """The lines with state as folds over all values so far, for checking on short panels."""
    alpha, far = 2 / (window + 1), f"PARTITION BY {KEY} ORDER BY {DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ema = lambda x: f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({far}), lambda a, v: {alpha!r} * v + (1 - {alpha!r}) * a)"
    line = lambda x: f"list_reduce(list_prepend(50.0, coalesce(list({x}) FILTER (WHERE {x} IS NOT NULL AND row_no > 1 AND RSV IS NOT NULL) OVER ({far}), [])), lambda a, v: v / 3 + a * (1 - 1 / 3.0))"
    extra = [{"EMA": ema("close"), "KDJ_K_3": line("RSV")}, {"ema_two": ema("EMA"), "KDJ_D_3": line("KDJ_K_3")}, {"ema_three": ema("ema_two")}]
    extra += [{"ema_prev": f"lag(ema_three, 1) OVER (PARTITION BY {KEY} ORDER BY {DATE})"}, {"TRIX": "(ema_three - ema_prev) / nullif(ema_prev, 0) * 100"}]
    return to_sql(bars.panel_sql(), "panel", needed(rolling.stages(window), ["RSV", "row_no"]) + extra + rolling.state_stages(), _columns(_STATE))


query("rolling_state_5", _state_sql(5))(lambda s, d: select(rolling.with_state(bars.panel(s, d), 5), _columns(_STATE)))


def _long_sql(metrics: tuple[str, ...], windows: tuple[int, ...]) -> str:
    parts = []
    for w in windows:
        one = to_sql(bars.panel_sql(), "panel", needed(rolling.stages(w), metrics), {KEY: KEY, DATE: DATE, **{m: m for m in metrics}})
        parts += [f"SELECT {KEY}, {DATE}, '{m}' AS metric, {w} AS \"window\", {significant(m)} AS value FROM ({one}) WHERE {m} IS NOT NULL" for m in metrics]
    return " UNION ALL ".join(parts)


@query("rolling_long", _long_sql(("CloseMA", "RSI", "PSY", "OBV"), (3, 5, 10)))
def _rolling_long(spark, sf_dir):
    return rolling.long_table(bars.panel(spark, sf_dir), ["CloseMA", "RSI", "PSY", "OBV"], (3, 5, 10)).selectExpr(KEY, DATE, "metric", "window", f"{significant('value')} AS value")


# --- the present against the past, long-short lines --------------------------------------------------------------


def _relative_sql(current: int, months: int, history: str, calendar: bool = False) -> str:
    """Written out with a join of each day's history, apart from the engine's sliding frames.  current: trading days, or months."""
    now = f"PARTITION BY {KEY} ORDER BY {DATE} ROWS BETWEEN {current - 1} PRECEDING AND CURRENT ROW"
    names = {
        "ReturnZScore": "(any_value(e.lvl) - avg(p.r)) / nullif(stddev_samp(p.r), 0)",
        "ReturnPercentile": "CASE WHEN any_value(e.ret) IS NOT NULL THEN count(*) FILTER (WHERE p.ret <= e.ret)::DOUBLE / nullif(count(p.ret), 0) END",
        "AverageDeviationReturn": "(any_value(e.lvl) - avg(p.r)) / nullif(avg(p.r), 0)",
        "VolatilityRollingRatio": "any_value(e.dev) / nullif(stddev_samp(p.r), 0)",
        "VolatilityPercentile": "CASE WHEN any_value(e.vol_) IS NOT NULL THEN count(*) FILTER (WHERE p.vol_ <= e.vol_)::DOUBLE / nullif(count(p.vol_), 0) END",
    }
    since = f"greatest(min({DATE}) OVER (PARTITION BY {KEY}), min(CASE WHEN log_return IS NOT NULL THEN {DATE} END) OVER (PARTITION BY {KEY}))"
    own = f"""c0 AS (SELECT e.{KEY}, e.{DATE}, any_value(e.log_return) AS r, bool_or(e.{DATE} - INTERVAL {current} MONTH >= e.first_row) AS whole, sum(p.log_return) AS s, avg(p.log_return) AS m, stddev_samp(p.log_return) AS sd, any_value(e.since) AS since
  FROM (SELECT *, min({DATE}) OVER (PARTITION BY {KEY}) AS first_row, {since} AS since FROM panel) e JOIN panel p ON p.{KEY} = e.{KEY} AND p.{DATE} <= e.{DATE} AND p.{DATE} > e.{DATE} - INTERVAL {current} MONTH GROUP BY e.{KEY}, e.{DATE}),"""
    rows = f"""c0 AS (SELECT {KEY}, {DATE}, log_return AS r, row_number() OVER (PARTITION BY {KEY} ORDER BY {DATE}) > {current} AS whole, sum(log_return) OVER ({now}) AS s, avg(log_return) OVER ({now}) AS m, stddev_samp(log_return) OVER ({now}) AS sd,
  {since} AS since FROM panel),"""
    return f"""WITH {bars.panel_sql('lineitem')},
{own if calendar else rows}
c AS (SELECT *, CASE WHEN whole THEN round(s, 10) END AS ret, CASE WHEN whole THEN m END AS lvl, CASE WHEN whole THEN sd END AS dev, CASE WHEN whole THEN round(sd, 10) END AS vol_ FROM c0),
h AS (SELECT e.{KEY}, e.{DATE}, {', '.join(f'CASE WHEN any_value(e.{DATE} - INTERVAL {months} MONTH >= e.since) THEN {x} END AS {n}_{history}' for n, x in names.items())}
  FROM c e JOIN c p ON p.{KEY} = e.{KEY} AND p.{DATE} <= e.{DATE} AND p.{DATE} > e.{DATE} - INTERVAL {months} MONTH GROUP BY e.{KEY}, e.{DATE})
SELECT {KEY}, {DATE}, {', '.join(f'{significant(f"{n}_{history}")} AS {n}_{history}' for n in names)} FROM h"""


for _history, _months in (("2m", 2), ("6m", 6), ("1y", 12), ("2y", 24)):
    for _days in (5, 25):
        _names = [f"{b}_{_history}" for b in relative.BASES]

        def _run_relative(s, d, days=_days, history=_history, names=_names):
            return select(relative.relative_metrics(bars.panel(s, d, "lineitem"), f"{days}d", history), _columns(names))

        query(f"relative_{_history}_{_days}d", _relative_sql(_days, _months, _history))(_run_relative)


@query("relative_2y_6m", _relative_sql(6, 24, "2y", True))
def _relative_calendar(spark, sf_dir):
    return select(relative.relative_metrics(bars.panel(spark, sf_dir, "lineitem"), "6m", "2y"), _columns([f"{b}_2y" for b in relative.BASES]))


_MEAN = lambda n, x="close": f"CASE WHEN row_number() OVER w >= {n} THEN avg({x}) OVER (w ROWS {n - 1} PRECEDING) END"
_ADX_SQL = to_sql(bars.panel_sql("lineitem"), "panel", needed(rolling.stages(14), ["ADX_6", "row_no"]), {KEY: KEY, DATE: DATE, "close": "close", "ADX_6": "ADX_6", "row_no": "row_no"})
query("lines_long_short", f"""WITH a AS ({_ADX_SQL}), b AS (SELECT *, ({_MEAN(3)} + {_MEAN(6)} + {_MEAN(12)} + {_MEAN(24)}) / 4 AS BBI, {_MEAN(10)} - {_MEAN(50)} AS gap,
  CASE WHEN count(ADX_6) OVER (w ROWS 5 PRECEDING) = 6 THEN regr_slope(ADX_6, row_no) OVER (w ROWS 5 PRECEDING) END AS ADXSlop_6 FROM a WINDOW w AS (PARTITION BY {KEY} ORDER BY {DATE})),
c AS (SELECT *, CASE WHEN row_number() OVER w >= 59 THEN avg(gap) OVER (w ROWS 9 PRECEDING) END AS DMA FROM b WINDOW w AS (PARTITION BY {KEY} ORDER BY {DATE}))
SELECT {KEY}, {DATE}, {', '.join(f'{rounded(x)} AS {x}' for x in ('BBI', 'DMA', 'ADXSlop_6'))} FROM c""")(
    lambda s, d: select(relative.long_short_lines(bars.panel(s, d, "lineitem"), ("BBI", "DMA", "ADXSlop_6")), {KEY: KEY, DATE: DATE, **{x: shown(x) for x in ("BBI", "DMA", "ADXSlop_6")}})
)
_EMA = lambda x, span: f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY {KEY} ORDER BY {DATE} ROWS UNBOUNDED PRECEDING), lambda a, v: v * 2.0 / ({span} + 1) + a * ({span} - 1.0) / ({span} + 1))"
query("lines_macd", f"""WITH {bars.panel_sql()}, a AS (SELECT {KEY}, {DATE}, {_EMA('close', 12)} - {_EMA('close', 26)} AS DIF FROM panel), b AS (SELECT *, {_EMA('DIF', 9)} AS DEA FROM a)
SELECT {KEY}, {DATE}, {rounded('DIF')} AS DIF, {rounded('DEA')} AS DEA, {rounded('2 * (DIF - DEA)')} AS MACD FROM b""")(
    lambda s, d: select(relative.long_short_lines(bars.panel(s, d), ("DIF", "DEA", "MACD")), {KEY: KEY, DATE: DATE, **{x: shown(x) for x in ("DIF", "DEA", "MACD")}})
)

# --- period metrics ----------------------------------------------------------------------------------------------

for _period, _kind in (("5d", "events"), ("10d", "events"), ("2w", "events"), ("5m", "lineitem"), ("1y", "lineitem"), ("mtd", "lineitem"), ("qtd", "lineitem"), ("ytd", "lineitem")):
    _sql = period.period_metrics_sql(bars.panel_sql(_kind), _period)

    def _run(s, d, p=_period, k=_kind):
        return period.period_metrics(bars.panel(s, d, k), p, digits=6)

    query(f"period_{_period}", _sql)(_run)


def _catalogue_sql(kind: str, periods: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{p}' AS period FROM ({period.period_metrics_sql(bars.panel_sql(kind), p)})" for p in periods)


@query("period_catalogue", _catalogue_sql("lineitem", period.PERIODS))
def _catalogue(spark, sf_dir):
    """Every metric of every period of the default catalogue."""
    return period.period_catalogue(bars.panel(spark, sf_dir, "lineitem"), digits=6)


_HURST_SQL = f"""WITH {bars.panel_sql('lineitem')}, {period.members_sql('5m')},
v AS (SELECT {KEY}, {period.END}, r, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {KEY}, {period.END}) AS n FROM members WHERE r IS NOT NULL WINDOW w AS (PARTITION BY {KEY}, {period.END} ORDER BY {DATE})),
p AS (SELECT {KEY}, {period.END}, level, n // (1 << level) AS size, i // (n // (1 << level)) AS part, (max(r) - min(r)) / CASE WHEN stddev_pop(r) = 0 THEN 1e-5 ELSE stddev_pop(r) END AS spread
  FROM v, (SELECT unnest(range(6))::INT AS level) WHERE n >= 64 AND i < (n // (1 << level)) * (1 << level) GROUP BY ALL),
l AS (SELECT {KEY}, {period.END}, level, log10(any_value(size)) AS x, log10(avg(spread)) AS y FROM p GROUP BY ALL), h AS (SELECT {KEY}, {period.END}, regr_slope(y, x) AS HurstExponent FROM l GROUP BY ALL)
SELECT e.{KEY}, e.{period.END}, {rounded('HurstExponent')} AS HurstExponent FROM (SELECT DISTINCT {KEY}, {period.END} FROM members) e LEFT JOIN h USING ({KEY}, {period.END})"""


@query("period_hurst_5m", _HURST_SQL)
def _hurst(spark, sf_dir):
    return period.hurst(bars.panel(spark, sf_dir, "lineitem"), "5m").selectExpr(KEY, period.END, f"{shown('HurstExponent')} AS HurstExponent")


# --- factor operators --------------------------------------------------------------------------------------------

_X, _Y = {"var": "close"}, {"var": "vol"}
_R = {"var": "log_return"}
_call = lambda f, *a, **k: {"func": f, "args": {**dict(zip(_parameters(f), a)), **k}}


def _parameters(name: str) -> list[str]:
    import inspect

    return list(inspect.signature(factor.OPERATORS[name]).parameters)[1:]


FACTORS = {
    "arithmetic": {"add": _call("add", _X, _Y), "subtract": _call("subtract", _X, _Y), "multiply": _call("multiply", _X, _R), "divide": _call("divide", _X, _Y), "log": _call("log", _X), "abs_val": _call("abs_val", _R), "power": _call("power", _R, 2), "sqrt": _call("sqrt", _R)},
    "cumulative": {"cumulative_sum": _call("cumulative_sum", _R), "cumulative_product": _call("cumulative_product", _R), "cumulative_max": _call("cumulative_max", _X), "cumulative_min": _call("cumulative_min", _X)},
    "windows": {f: _call(f, _X if f not in ("rolling_product", "downside_deviation") else _R, 5) for f in ("rolling_sum", "rolling_product", "rolling_max", "rolling_min", "rolling_std", "moving_average", "ts_mean", "ts_std", "downside_deviation", "ts_delay", "ts_delta")},
    "moments": {"rolling_skew": _call("rolling_skew", _R, 6), "rolling_kurt": _call("rolling_kurt", _R, 6), "rolling_quantile": _call("rolling_quantile", _X, 6, 0.3), "ts_rank": _call("ts_rank", _X, 6)},
    "pairs": {"rolling_corr": _call("rolling_corr", _R, {"var": "benchmark"}, 6), "rolling_cov": _call("rolling_cov", _R, {"var": "benchmark"}, 6), "alpha": _call("alpha", _R, {"var": "benchmark"}, 6), "beta": _call("beta", _R, {"var": "benchmark"}, 6), "excess_return": _call("excess_return", _R, {"var": "benchmark"}), "correlation": _call("correlation", _R, {"var": "benchmark"}), "covariance": _call("covariance", _R, {"var": "benchmark"})},
    "statistics": {**{f: _call(f, _X) for f in ("mean", "std_dev", "variance", "max_val", "min_val", "median")}, "mean_across": _call("mean", _X, axis=1), "variance_2": _call("variance", _X, 0, 2), "quantile": _call("quantile", _X, 0.25)},
    "ratios": {f: _call(f, _R, 6) for f in ("sharpe_ratio", "sortino_ratio", "calmar_ratio", "rolling_max_drawdown")},
    "decay": {"exponential_moving_average": _call("exponential_moving_average", _X, 5), "time_series_decay": _call("time_series_decay", _R, 3)},
    "cross_section": {"neutralize": _call("neutralize", _R, _Y), "winsorize": _call("winsorize", _X), "winsorize_across": _call("winsorize", _X, 0.05, 0.95, 1), "clip": _call("clip", _R, -0.5, 0.5), "cross_sectional_rank": _call("cross_sectional_rank", _R), "cross_sectional_scale": _call("cross_sectional_scale", _R)},
    "filling": {f"fill_{m}": _call("fill_na", _X, m) for m in ("ffill", "bfill", "zero", "mean", "median")} | {"fill_value": _call("fill_na", _X, "value", 1.5)},
    "nested": {"nested": _call("divide", _call("ts_delta", _call("moving_average", _X, 3.0), 2), _call("rolling_std", _call("fill_na", _R, "zero"), 5))},
}
_VARIABLES = {KEY, DATE, "open", "high", "low", "close", "vol", "amount", "log_return", "benchmark"}
_WITH_BENCHMARK = bars.panel_sql() + f", marked AS (SELECT *, sum(log_return) OVER (PARTITION BY {DATE}) / (SELECT count(DISTINCT {KEY}) FROM panel) AS benchmark FROM panel)"


def _marked(spark, sf_dir):
    return prepare.mark_equal_weight(bars.panel(spark, sf_dir))


def _factors(trees: dict) -> tuple[factor.FactorPlan, dict[str, str]]:
    plan, out = factor.FactorPlan(), {}
    for name, tree in trees.items():
        out[name] = expression.compile_node(plan, expression.normalise(tree), _VARIABLES)
    return plan, out


for _name, _trees in FACTORS.items():
    _plan, _out = _factors(_trees)
    _sql = _plan.sql(_WITH_BENCHMARK, "marked", [KEY, DATE, *(f'{rounded(c)} AS "{n}"' for n, c in _out.items())])

    def _run_factors(s, d, trees=_trees):
        plan, out = _factors(trees)
        return plan.apply(_marked(s, d)).selectExpr(KEY, DATE, *(f"{shown(c)} AS `{n}`" for n, c in out.items()))

    query(f"factor_{_name}", _sql)(_run_factors)

# --- factor evaluation -------------------------------------------------------------------------------------------

_TREE = _call("ts_delta", _call("moving_average", _X, 3), 2)
_EVAL = {"factor": _TREE}
_plan, _out = _factors(_EVAL)
_EVAL_SQL = _plan.sql(_WITH_BENCHMARK, "marked", ["*", f"{_out['factor']} AS factor", f"{evaluation.forward_returns()} AS forward"])
_EVAL_BASE = f"evaluated AS ({_EVAL_SQL})"


def _evaluated(spark, sf_dir):
    p = _marked(spark, sf_dir)
    return expression.factor_values(p, _TREE).selectExpr(KEY, DATE, "factor", f"{evaluation.forward_returns()} AS forward")


for _ranked in (False, True):
    _n = "rank_ic" if _ranked else "ic"
    _daily = evaluation.daily_ic_sql(_EVAL_BASE, "evaluated", _ranked)
    query(f"eval_{_n}", f"SELECT {DATE}, floor(CAST(ic AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS ic, n FROM ({_daily})")(lambda s, d, r=_ranked: evaluation.daily_ic(_evaluated(s, d), r).selectExpr(DATE, f"{shown('ic')} AS ic", "n"))
    _summary = ", ".join(f"floor(CAST({e} AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS {n}" if n != "n_dates" else f"{e} AS {n}" for n, e in evaluation.SUMMARY.items())
    query(f"eval_{_n}_summary", f"SELECT {_summary} FROM ({_daily})")(lambda s, d, r=_ranked: evaluation.ic_summary(evaluation.daily_ic(_evaluated(s, d), r)).selectExpr(*(f"{shown(n)} AS {n}" if n != "n_dates" else n for n in evaluation.SUMMARY)))
query("eval_turnover", evaluation.turnover_sql(_EVAL_BASE, "evaluated"))(lambda s, d: evaluation.turnover(_evaluated(s, d)).selectExpr(DATE, f"{shown('turnover')} AS turnover"))
query("eval_groups", evaluation.groups_sql(_EVAL_BASE, "evaluated", "groups"))(lambda s, d: evaluation.group_returns(_evaluated(s, d)).selectExpr("bucket", f"{shown('mean_return')} AS mean_return", "n"))
query("eval_long_short", evaluation.groups_sql(_EVAL_BASE, "evaluated", "spread"))(lambda s, d: evaluation.long_short(_evaluated(s, d)).selectExpr(DATE, f"{shown('spread')} AS spread"))


_GROUPS = evaluation.groups_sql(_EVAL_BASE, "evaluated", "groups")
query("eval_monotonic", f"SELECT coalesce(bool_and(up), true) OR coalesce(bool_and(down), true) AS monotonic FROM (SELECT mean_return >= lag(mean_return) OVER (ORDER BY bucket) AS up, mean_return <= lag(mean_return) OVER (ORDER BY bucket) AS down FROM ({_GROUPS}))")(
    lambda s, d: evaluation.is_monotonic(_evaluated(s, d))
)
_SPREAD = evaluation.groups_sql(_EVAL_BASE, "evaluated", "raw")
query("eval_long_short_summary", f"SELECT {significant('(product(1 + spread) - 1)')} AS total_return, {rounded('avg(spread)', 5)} AS mean, {rounded('stddev_samp(spread)', 5)} AS std, {rounded('(avg(spread) / nullif(stddev_samp(spread), 0) * sqrt(252))', 4)} AS sharpe FROM ({_SPREAD})")(
    lambda s, d: evaluation.long_short_summary(evaluation.long_short(_evaluated(s, d))).selectExpr(f"{significant('total_return')} AS total_return", *(f"{shown(c, k)} AS {c}" for c, k in (("mean", 5), ("std", 5), ("sharpe", 4))))
)
for _ranked in (False, True):
    _n = "rank_ic" if _ranked else "ic"
    _daily = evaluation.daily_ic_sql(_EVAL_BASE, "evaluated", _ranked)
    _summary = f"SELECT {', '.join(f'{evaluation.SUMMARY[c]} AS {c}' for c in ('t_stat', 'n_dates'))} FROM ({_daily})"
    query(f"eval_{_n}_p_value", f"SELECT n_dates, {rounded('t_stat')} AS t_stat, {rounded(two_sided_p_sql('t_stat', 'n_dates'))} AS p_value FROM ({_summary})")(lambda s, d, r=_ranked: evaluation.ic_summary(evaluation.daily_ic(_evaluated(s, d), r)).selectExpr("n_dates", f"{shown('t_stat')} AS t_stat", f"{shown('p_value')} AS p_value"))


query("eval_forward_log", f"WITH {bars.panel_sql()}, n AS (SELECT {KEY}, {DATE}, close, lead(close) OVER (PARTITION BY {KEY} ORDER BY {DATE}) AS later FROM panel) SELECT {KEY}, {DATE}, CASE WHEN close > 0 AND later > 0 THEN {rounded('ln(later) - ln(close)')} END AS forward FROM n")(
    lambda s, d: bars.panel(s, d).selectExpr(KEY, DATE, f"{evaluation.forward_returns('log')} AS f").selectExpr(KEY, DATE, f"{shown('f')} AS forward")
)


@query("eval_report")
def _report(spark, sf_dir):
    return spark.createDataFrame([(evaluation.report(_evaluated(spark, sf_dir)),)], "report string")


_LINE = {**{f"{n}_{c}": 4 for n in ("ic", "rank_ic") for c in ("ic_mean", "ic_std", "icir", "t_stat", "p_value")}, "turnover": 6, "mean": 5, "std": 5, "sharpe": 4}


def _report_sql() -> str:
    parts = []
    for n, ranked in (("ic", False), ("rank_ic", True)):
        one = f"SELECT {', '.join(f'{e} AS {c}' for c, e in evaluation.SUMMARY.items())} FROM ({evaluation.daily_ic_sql(_EVAL_BASE, 'evaluated', ranked)})"
        parts.append(f"(SELECT {', '.join(f'{c} AS {n}_{c}' for c in evaluation.SUMMARY)}, {two_sided_p_sql('t_stat', 'n_dates')} AS {n}_p_value FROM ({one}))")
    parts.append(f"(SELECT avg(turnover) AS turnover FROM ({evaluation.turnover_sql(_EVAL_BASE, 'evaluated')}))")
    parts.append(f"(SELECT product(1 + spread) - 1 AS total_return, avg(spread) AS mean, stddev_samp(spread) AS std, avg(spread) / nullif(stddev_samp(spread), 0) * sqrt(252) AS sharpe FROM ({_SPREAD}))")
    parts.append(f"({ORACLES['eval_monotonic']})")
    return f"SELECT {', '.join(f'{rounded(c, k)} AS {c}' for c, k in _LINE.items())}, {significant('total_return')} AS total_return, ic_n_dates, rank_ic_n_dates, monotonic FROM {', '.join(parts)}"


@query("eval_report_numbers", _report_sql())
def _report_numbers(spark, sf_dir):
    """The report as one row."""
    got = evaluation.report_numbers(_evaluated(spark, sf_dir))
    row = {f"{n}_{c}": v for n in ("ic", "rank_ic") for c, v in got[n].items()} | {"turnover": got["turnover"]["mean_turnover"], "monotonic": got["groups"]["monotonic"], **got["long_short"]}
    kinds = ", ".join(f"{c} {'long' if c.endswith('n_dates') else 'boolean' if c == 'monotonic' else 'double'}" for c in row)
    return spark.createDataFrame([tuple(row.values())], kinds).selectExpr(*(f"{shown(c, k)} AS {c}" for c, k in _LINE.items()), f"{significant('total_return')} AS total_return", "ic_n_dates", "rank_ic_n_dates", "monotonic")


# --- feature preparation and portfolios --------------------------------------------------------------------------

_TRAIN_END, _PREPARED = "2024-01-20", ("vol", "log_return")


def _prepared(spark, sf_dir):
    rows = bars.panel(spark, sf_dir).select(KEY, DATE, "close", *_PREPARED)
    train, test = modelling.prepare(rows, list(_PREPARED), 3, 0.0, _TRAIN_END, "2024-01-21", "2024-01-30", fill="median")
    return train.unionByName(test).selectExpr(KEY, DATE, "label", *(f"{shown(c)} AS {c}" for c in _PREPARED))


def _prepared_sql() -> str:
    """Numbers of the training part alone, written out apart from the engine."""
    fill = ", ".join(f"quantile_cont({c}, 0.5) AS f_{c}" for c in _PREPARED)
    stats = ", ".join(f"min(coalesce({c}, f_{c})) AS lo_{c}, max(coalesce({c}, f_{c})) AS hi_{c}, avg(coalesce({c}, f_{c})) AS mu_{c}, stddev_pop(coalesce({c}, f_{c})) AS sd_{c}" for c in _PREPARED)
    one = lambda c: rounded(f"(CASE WHEN lo_{c} >= 0 THEN (coalesce({c}, f_{c}) - lo_{c}) / (hi_{c} - lo_{c}) WHEN hi_{c} <= 0 THEN (hi_{c} - coalesce({c}, f_{c})) / (hi_{c} - lo_{c}) ELSE (coalesce({c}, f_{c}) - mu_{c}) / sd_{c} END)")
    return f"""WITH {bars.panel_sql()}, l AS (SELECT *, lead(close, 3) OVER (PARTITION BY {KEY} ORDER BY {DATE}) AS later FROM panel),
t AS (SELECT * FROM l WHERE {DATE} <= DATE '{_TRAIN_END}'), f AS (SELECT {fill} FROM t), s AS (SELECT {stats} FROM t, f)
SELECT {KEY}, {DATE}, CASE WHEN close > 0 AND later > close THEN 1 ELSE 0 END AS label, {', '.join(f'{one(c)} AS {c}' for c in _PREPARED)} FROM l, f, s WHERE {DATE} <= DATE '2024-01-30'"""


query("features_prepared", _prepared_sql())(_prepared)


_KNOWN = ("close", "vol", "log_return")
_SEQUENCE_SQL = f"""WITH {bars.panel_sql()}, b AS (SELECT *, greatest({', '.join(f'min(CASE WHEN {c} IS NOT NULL THEN {DATE} END) OVER (PARTITION BY {KEY})' for c in _KNOWN)}) AS begun FROM panel),
f AS (SELECT {KEY}, {DATE}, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY {KEY} ORDER BY {DATE} ROWS UNBOUNDED PRECEDING) AS {c}' for c in _KNOWN)} FROM b WHERE {DATE} >= begun),
k AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {DATE}) <= floor(count(*) OVER (PARTITION BY {KEY}) * 0.8) AS early FROM f WHERE close IS NOT NULL AND vol IS NOT NULL AND log_return IS NOT NULL),
t AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _KNOWN[1:])} FROM k WHERE early)
SELECT {KEY}, {DATE}, CASE WHEN early THEN 'train' ELSE 'test' END AS part, {rounded('close')} AS close, {', '.join(f'{rounded(f"(({c} - m_{c}) / s_{c})")} AS {c}' for c in _KNOWN[1:])} FROM k, t"""


@query("features_sequence", _SEQUENCE_SQL)
def _sequence(spark, sf_dir):
    train, test = modelling.prepare_sequence(bars.panel(spark, sf_dir), ["vol", "log_return"])
    part = F.lit("train").alias("part"), F.lit("test").alias("part")
    return train.select("*", part[0]).unionByName(test.select("*", part[1])).selectExpr(KEY, DATE, "part", *(f"{shown(c)} AS {c}" for c in ("close", "vol", "log_return")))


@query("features_cross")
def _cross(spark, sf_dir):
    rows = features.assemble(bars.panel(spark, sf_dir), ("RSI", "BIAS"), (3,)).selectExpr("*", f"{features.future_log_return(3)} AS forward")
    chosen = modelling.cross_features(rows, ["RSI_3", "BIAS_3"], "forward", 3)
    return modelling.with_cross_features(rows, chosen).select(KEY, DATE, *chosen)


_PAIRS = ("RSI", "PSY"), (3, 5)


@query("features_merged", to_sql(bars.panel_sql(), "panel", rolling.windowed(*_PAIRS), _columns(["close", *(f"{m}_{w}" for w in _PAIRS[1] for m in _PAIRS[0])])))
def _merged(spark, sf_dir):
    rows = modelling.assemble(bars.panel(spark, sf_dir), *_PAIRS)
    return select(rows, _columns(["close", *(f"{m}_{w}" for w in _PAIRS[1] for m in _PAIRS[0])]))


query("portfolio_max_sharpe")(lambda s, d: portfolio.max_sharpe(bars.panel(s, d), 2000).selectExpr(KEY, f"{shown('weight')} AS weight", f"{shown('sharpe', 4)} AS sharpe"))


def _portfolios(spark, sf_dir):
    """Three portfolios: a market's codes by the number in their names, tilted to what rose."""
    p = bars.panel(spark, sf_dir).selectExpr(f"concat('P', cast(substr({KEY}, 2) as int) % 3) AS portfolio", KEY, DATE, "close", "log_return")
    return p.selectExpr("*", "coalesce(log_return, 0D) AS action", "0D AS cash_action")


query("portfolio_replay")(lambda s, d: portfolio.replay_weights(_portfolios(s, d)).selectExpr("portfolio", DATE, f"{shown('value', 4)} AS value"))
_BUCKET_SQL = f"'P' || (substr({KEY}, 2)::INT % 3)"
_ALLOCATED_SQL = f"""WITH {bars.panel_sql()},
a AS (SELECT {_BUCKET_SQL} AS portfolio, {KEY}, {DATE}, coalesce(log_return, 0) AS r, lag(coalesce(log_return, 0)) OVER (PARTITION BY {KEY} ORDER BY {DATE}) AS w FROM panel),
g AS (SELECT portfolio, {DATE}, CASE WHEN any_value(w) IS NULL THEN avg(r) ELSE sum(w * r) END AS gain FROM a GROUP BY ALL),
l AS (SELECT *, exp(sum(gain) OVER d) AS value, CASE WHEN row_number() OVER d >= 22 THEN 0.1 * stddev_pop(gain) OVER (d ROWS 21 PRECEDING) ELSE 0 END AS cost FROM g WINDOW d AS (PARTITION BY portfolio ORDER BY {DATE}))
SELECT portfolio, {DATE}, {significant('value')} AS value, {rounded('(gain - cost)')} AS reward FROM l"""
query("portfolio_allocations", _ALLOCATED_SQL)(lambda s, d: portfolio.replay_allocations(_portfolios(s, d)).selectExpr("portfolio", DATE, f"{significant('value')} AS value", f"{shown('reward')} AS reward"))

# --- screens, preparation, features, stocks ----------------------------------------------------------------------

for _module in (screen, prepare, features, stocks, orders):
    for _name, (_f, _sql) in _module.QUERIES.items():
        query(_name, _sql)(_f)


def explain(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The formatted physical plan of a query."""
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def count_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    return QUERIES[name](spark, sf_dir).agg(F.count("*")).first()[0]
