"""Feature tables and labels: assembly, forward returns, imputing, scaling, splits, back-test replay."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY
from barsmith.operators import rolling
from barsmith.plans import selection
from barsmith.plans.staged import rounded, select, shown, significant, to_sql
from barsmith.sources import bars as source

_TIME = f"PARTITION BY {KEY} ORDER BY {DATE}"
#: Ranges of scores in the search for a threshold.
SCORE_BINS = 4096


def future_log_return(days: int) -> str:
    later = f"lead(close, {days}) OVER ({_TIME})"
    return f"CASE WHEN close > 0 AND {later} > 0 THEN ln({later} / close) END"


def label(returns: str, threshold: float = 0.0, classes: int = 2) -> str:
    """1 for a rise, else 0; with three classes 2, 1, 0 above, within and below the threshold.  A missing return is 0, or 1 of three."""
    if classes == 2:
        return f"CASE WHEN {returns} > {threshold} THEN 1 ELSE 0 END"
    return f"CASE WHEN {returns} > {threshold} THEN 2 WHEN {returns} < {-threshold} THEN 0 ELSE 1 END"


def assemble(panel: DataFrame, metrics: Iterable[str] = ("CloseMA", "RSI", "BIAS", "PSY"), windows: Iterable[int] = (3, 5, 10)) -> DataFrame:
    """(ts_code, trade_date, bars, metric_window columns) of plain indicators: one exchange and sort by code."""
    names = [f"{rolling.column(m)}_{w}" for w in windows for m in metrics]
    return rolling.apply(panel, rolling.windowed([rolling.column(m) for m in metrics], windows)).select(KEY, DATE, "close", "open", "high", "low", "vol", *names)


def index_features(dates: DataFrame, series: DataFrame) -> DataFrame:
    """Each index's level on each date, the last one known; a column a series."""
    wide = series.groupBy(DATE).pivot(KEY).agg(F.first("close"))
    days = dates.select(DATE).distinct().join(wide, DATE, "full")
    back = Window.orderBy(DATE)  # a row a day
    return days.select(DATE, *(F.last(c, ignorenulls=True).over(back).alias(c) for c in wide.columns if c != DATE))


def impute(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Nulls by a column's median or mean over all rows, or rows with a null dropped."""
    if how == "drop":
        return df.dropna(subset=columns)
    stat = (lambda c: F.expr(f"percentile(`{c}`, 0.5)")) if how == "median" else F.avg
    stats = df.agg(*(stat(c).alias(f"_{c}") for c in columns))
    return df.join(F.broadcast(stats)).select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def scale(df: DataFrame, columns: list[str], how: str = "both") -> DataFrame:
    """By the numbers of the frame itself (modelling.fit takes them from a training part): minmax, zscore (population deviation), none, or both: by sign of a column's values minmax, minmax of the absolute value, or z-score."""
    if how == "none":
        return df
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg), ("sd", F.stddev_pop))))

    def one(c: str) -> str:
        z = f"(`{c}` - `_mu_{c}`) / nullif(`_sd_{c}`, 0)"
        mm = f"(`{c}` - `_lo_{c}`) / nullif(`_hi_{c}` - `_lo_{c}`, 0)"
        if how in ("minmax", "zscore"):
            return mm if how == "minmax" else z
        neg = f"(- `{c}` + `_hi_{c}`) / nullif(`_hi_{c}` - `_lo_{c}`, 0)"
        return f"CASE WHEN `_lo_{c}` >= 0 THEN {mm} WHEN `_hi_{c}` <= 0 THEN {neg} ELSE {z} END"

    return df.join(F.broadcast(stats)).select(*(F.expr(one(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def split(df: DataFrame, train_end: str, test_start: str, test_end: str, train_start: str | None = None) -> tuple[DataFrame, DataFrame]:
    day = lambda s: F.lit(s).cast("date")
    train = df.where(F.col(DATE) <= day(train_end))
    if train_start:
        train = train.where(F.col(DATE) >= day(train_start))
    return train, df.where(F.col(DATE).between(day(test_start), day(test_end)))


def reduce_dimensions(df: DataFrame, columns: list[str], keep: float = 0.99) -> DataFrame:
    """Principal components that together explain keep of the variance, as a vector column."""
    from pyspark.ml.feature import PCA, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_v").transform(df)
    full = PCA(k=len(columns), inputCol="_v", outputCol="components").fit(rows)
    k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), keep - 1e-12) + 1)
    return PCA(k=min(k, len(columns)), inputCol="_v", outputCol="components").fit(rows).transform(rows).drop("_v")


def forest(train: DataFrame, test: DataFrame, columns: list[str], target: str = "label", sure: float = 0.7, trees: int = 50, seed: int = 42) -> DataFrame:
    """test with prediction, its probability and whether that is sure enough."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    to = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip")
    model = RandomForestClassifier(featuresCol="_v", labelCol=target, numTrees=trees, seed=seed).fit(to.transform(train))
    out = model.transform(to.transform(test)).withColumn("certainty", F.array_max(vector_to_array("probability")))
    return out.withColumn("sure", F.col("certainty") >= sure).drop("_v", "rawPrediction", "probability")


def important_features(train: DataFrame, columns: list[str], target: str = "label", top: int = 10) -> list[str]:
    """Union of the most important columns of a forest, of extremely randomised trees, boosted trees, a lasso
    regression and a linear support vector machine."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows, found = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(train), []
    weights = []
    for model in (RandomForestClassifier(featuresCol="_v", labelCol=target, seed=42), GBTClassifier(featuresCol="_v", labelCol=target, maxIter=10, seed=42), LogisticRegression(featuresCol="_v", labelCol=target, elasticNetParam=1.0, regParam=0.01), LinearSVC(featuresCol="_v", labelCol=target, regParam=0.01, maxIter=50)):
        fitted = model.fit(rows)
        weights.append(fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else fitted.coefficients.toArray())
    weights.insert(1, selection.extra_trees(train, columns, target, seed=43)[1])
    for weight in map(np.abs, weights):
        found += [columns[i] for i in np.argsort(-weight)[:top] if columns[i] not in found]
    return found


def rolling_zscore(column: str, window: int) -> str:
    """Distance from the mean of the rows before, in their deviations; a deviation of 0 counts as 0.001."""
    w = f"{_TIME} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING"
    return f"CASE WHEN count({column}) OVER ({w}) >= {window} THEN ({column} - avg({column}) OVER ({w})) / CASE WHEN stddev_samp({column}) OVER ({w}) = 0 THEN 0.001 ELSE stddev_samp({column}) OVER ({w}) END END"


def price_relative(column: str, lag: int = 1) -> str:
    return f"coalesce({column} / nullif(lag({column}, {lag}) OVER ({_TIME}), 0), 1.0)"


def future_volatility(days: int) -> str:
    w = f"{_TIME} ROWS BETWEEN CURRENT ROW AND {days - 1} FOLLOWING"
    return f"CASE WHEN count(log_return) OVER ({w}) >= {days} THEN stddev_samp(log_return) OVER ({w}) END"


def future_trend(days: int) -> str:
    """1 where the price so many rows on is above today's, 0 where not, null where there is none."""
    return f"CASE WHEN {future_log_return(days)} > 0 THEN 1 WHEN {future_log_return(days)} <= 0 THEN 0 END"


def replay(actions: DataFrame, cash: float = 10_000.0, fee: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """(ts_code, trade_date, equity) of a strategy that holds the share of its wealth that `action` (0 to 1) says.

    Trades pay a fee and slip; a code's history is replayed in one pass."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        money, shares, equity = cash, 0.0, []
        # one factor each: what a purchase of all leaves by rounding counts where a price falls to 0
        bought, sold = (1 + slippage) * (1 + fee), (1 - slippage) * (1 - fee)
        for price, share in zip(pdf["close"].to_numpy(float), pdf["action"].to_numpy(float)):
            if price == price and price > 0 and share == share:
                wealth = money + shares * price
                change = share * wealth / price - shares
                if change > 0:
                    change = min(change, money / (price * (1 + slippage) * (1 + fee)))
                    money -= change * price * bought
                else:
                    money -= change * price * sold
                shares += change
            equity.append(money + shares * price if price == price else (equity[-1] if equity else cash))
        return pd.DataFrame({KEY: pdf[KEY].values, DATE: pdf[DATE].values, "equity": equity})

    return actions.select(KEY, DATE, "close", "action").groupBy(KEY).applyInPandas(each, f"{KEY} string, {DATE} date, equity double")


#: Sample deviation of x over a code's days in their order (Welford's recursion).  Where a price falls to 0, returns of what is
#: left reach 1e15, and the last digit of the built-in deviation depends on how partial results are merged.
_SPREAD = f"""aggregate(filter(transform(sort_array(collect_list(struct({DATE}, r))), x -> x.r), x -> x IS NOT NULL), named_struct('n', 0D, 'mean', 0D, 'm2', 0D),
  (a, x) -> named_struct('n', a.n + 1, 'mean', a.mean + (x - a.mean) / (a.n + 1), 'm2', a.m2 + (x - (a.mean + (x - a.mean) / (a.n + 1))) * (x - a.mean)), a -> CASE WHEN a.n > 1 THEN sqrt(a.m2 / (a.n - 1)) END)"""


def episode_stats(equity: DataFrame, periods: int = 252) -> DataFrame:
    """(ts_code, total_return, volatility, sharpe) of replayed equity."""
    r = equity.selectExpr(KEY, DATE, "equity", f"equity / nullif(lag(equity) OVER ({_TIME}), 0) - 1 AS r")
    root = periods**0.5
    by = r.groupBy(KEY).agg((F.max_by("equity", DATE) / F.min_by("equity", DATE) - 1).alias("total_return"), F.expr(_SPREAD).alias("sd"), F.avg("r").alias("mean"))
    return by.select(KEY, "total_return", (F.col("sd") * root).alias("volatility"), F.expr(f"mean / nullif(sd, 0) * {root}").alias("sharpe"))


def optimal_threshold(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the score at which predicting 1 from it on gives the best F1, and that F1.

    Scores are counted in so many ranges first; a score's rank is the sum over the ranges above its own (a
    window over SCORE_BINS rows) and over the scores above it in its range, so no task orders all scores."""
    by = scored.groupBy(score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    lo, hi, all_p = by.agg(F.min(score), F.max(score), F.sum("p")).first()
    if lo is None:
        return by.select(F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("f1")).limit(0)
    by = by.withColumn("_bin", F.least(F.lit(SCORE_BINS - 1), F.floor((F.col(score) - lo) * (SCORE_BINS / ((hi - lo) or 1.0)))).cast("int"))
    above = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = by.groupBy("_bin").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    bins = bins.select("_bin", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_bin").orderBy(F.desc(score))
    rows = by.join(F.broadcast(bins), "_bin").withColumns({"hit": F.col("_p") + F.sum("p").over(inside), "said": F.col("_n") + F.sum("n").over(inside)})
    rows = rows.withColumn("f1", F.expr("2e0 * hit") / F.nullif(F.col("said") + F.lit(all_p), F.lit(0)))
    return rows.agg(F.max(F.struct("f1", score)).alias("m")).selectExpr(f"m.{score} AS threshold", "m.f1")


# --- queries -----------------------------------------------------------------------------------------------------

_LABELS = {"future": future_log_return(3), "next_volatility": future_volatility(4), "z": rolling_zscore("close", 5), "relative": price_relative("close"), "trend": future_trend(3)}


def _labels(s, d):
    rows = source.panel(s, d).selectExpr(KEY, DATE, *(f"{e} AS {n}" for n, e in _LABELS.items()))
    return rows.selectExpr(KEY, DATE, *(f"{shown(n)} AS {n}" for n in _LABELS), f"{label('future')} AS label", f"{label('future', 0.2, 3)} AS label3")


_LABELS_SQL = f"WITH {source.panel_sql()}, l AS (SELECT {KEY}, {DATE}, {', '.join(f'{e} AS {n}' for n, e in _LABELS.items())} FROM panel) SELECT {KEY}, {DATE}, {', '.join(f'floor(CAST({n} AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS {n}' for n in _LABELS)}, {label('future')} AS label, {label('future', 0.2, 3)} AS label3 FROM l"


def _scaled(s, d):
    cols = ["close", "vol", "log_return"]
    return scale(impute(source.panel(s, d), cols), cols).selectExpr(KEY, DATE, *(f"{shown(c)} AS {c}" for c in cols))


_SCALED_SQL = f"""WITH {source.panel_sql()}, i AS (SELECT {KEY}, {DATE}, {', '.join(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM panel)) AS {c}' for c in ('close', 'vol', 'log_return'))} FROM panel)
SELECT {KEY}, {DATE}, {', '.join(f'floor(CAST(CASE WHEN min({c}) OVER () >= 0 THEN ({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) WHEN max({c}) OVER () <= 0 THEN (max({c}) OVER () - {c}) / nullif(max({c}) OVER () - min({c}) OVER (), 0) ELSE ({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) END AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS {c}' for c in ('close', 'vol', 'log_return'))} FROM i"""


_ASSEMBLED = {KEY: KEY, DATE: DATE, **{n: significant(n) for n in ("close", *(f"{m}_{w}" for w in (3, 5, 10) for m in ("CloseMA", "RSI", "BIAS", "PSY")))}}
_ASSEMBLED_SQL = to_sql(source.panel_sql(), "panel", rolling.windowed(("CloseMA", "RSI", "BIAS", "PSY"), (3, 5, 10)), _ASSEMBLED)


def _assembled(s, d):
    return select(assemble(source.panel(s, d)), _ASSEMBLED)


def _model(s, d):
    p = source.panel(s, d)
    rows = assemble(p, ("RSI", "BIAS"), (3, 5)).selectExpr("*", f"{label(future_log_return(3))} AS label")
    cols = [f"{m}_{w}" for m in ("RSI", "BIAS") for w in (3, 5)]
    train, test = split(rows.dropna(subset=cols), "2024-01-20", "2024-01-21", "2024-01-30")
    return forest(train, test, cols, trees=10).select(KEY, DATE, "label", "prediction", "sure")


def _replayed(s, d):
    p = source.panel(s, d).selectExpr(KEY, DATE, "close", "CASE WHEN log_return > 0 THEN 1e0 WHEN log_return <= 0 THEN 0e0 END AS action")
    return episode_stats(replay(p)).selectExpr(KEY, f"{shown('total_return')} AS total_return", f"{shown('volatility')} AS volatility", f"{shown('sharpe')} AS sharpe")


#: The replay as a recursion over a code's rows.
_REPLAY_SQL = f"""WITH RECURSIVE {source.panel_sql()}, p AS (SELECT {KEY}, close, CASE WHEN log_return > 0 THEN 1.0 WHEN log_return <= 0 THEN 0.0 END AS share, row_number() OVER (PARTITION BY {KEY} ORDER BY {DATE}) AS n FROM panel),
s AS (SELECT DISTINCT {KEY}, 0::BIGINT AS n, 10000.0::DOUBLE AS money, 0.0::DOUBLE AS shares, 10000.0::DOUBLE AS equity FROM p UNION ALL
  SELECT {KEY}, n, m, h, CASE WHEN close IS NOT NULL THEN m + h * close ELSE equity END FROM (SELECT *, shares + step AS h, money - step * coalesce(close, 0) * CASE WHEN step > 0 THEN 1.0005 * 1.001 ELSE 0.9995 * 0.999 END AS m
    FROM (SELECT *, CASE WHEN close > 0 AND share IS NOT NULL THEN CASE WHEN wish > 0 THEN least(wish, money / (close * 1.0005 * 1.001)) ELSE wish END ELSE 0 END AS step
      FROM (SELECT s.{KEY}, p.n, s.money, s.shares, s.equity, p.close, p.share, p.share * (s.money + s.shares * p.close) / p.close - s.shares AS wish FROM s JOIN p ON p.{KEY} = s.{KEY} AND p.n = s.n + 1)))),
r AS (SELECT {KEY}, n, equity, equity / nullif(lag(equity) OVER (PARTITION BY {KEY} ORDER BY n), 0) - 1 AS r FROM s WHERE n > 0)
SELECT {KEY}, {rounded('arg_max(equity, n) / arg_min(equity, n) - 1')} AS total_return, {rounded('stddev_samp(r) * sqrt(252)')} AS volatility, {rounded('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252)')} AS sharpe FROM r GROUP BY {KEY}"""
QUERIES = {"features_labels": (_labels, _LABELS_SQL), "features_scaled": (_scaled, _SCALED_SQL), "features_forest": (_model, None), "features_replay": (_replayed, _REPLAY_SQL), "features_assembled": (_assembled, _ASSEMBLED_SQL)}
