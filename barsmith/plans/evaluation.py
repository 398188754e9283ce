"""Factor evaluation: information coefficients, turnover, quantile and long-short returns.

Each analysis is a plan over (trade_date, ts_code, factor, forward): grouped by
date, then one small aggregate over dates.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame

from barsmith.functions.dialect import DATE, KEY, Duck, Spark, finite
from barsmith.functions.student import two_sided_p
from barsmith.plans.staged import Stage, apply

PERIODS = 252


def forward_returns(kind: str = "simple") -> str:
    """Return from this row's close to the code's next row's."""
    nxt = f"lead(close, 1) OVER (PARTITION BY {KEY} ORDER BY {DATE})"
    if kind == "log":
        return f"CASE WHEN close > 0 AND {nxt} > 0 THEN ln({nxt} / close) END"
    return f"{nxt} / nullif(close, 0) - 1"


def average_rank(x: str, by: str = DATE) -> str:
    """Rank from 1 among a date's values, ties at their mean."""
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0 END"


def both(df: DataFrame) -> DataFrame:
    return df.where("factor IS NOT NULL AND forward IS NOT NULL")


RANK_STAGES: list[Stage] = [{"factor_rank": average_rank("factor"), "forward_rank": average_rank("forward")}]


def daily_ic(df: DataFrame, ranked: bool = False) -> DataFrame:
    """(trade_date, ic, n): Pearson's, or with ranks Spearman's, correlation of each date with two codes or more."""
    rows = both(df)
    x, y = ("factor_rank", "forward_rank") if ranked else ("factor", "forward")
    if ranked:
        rows = apply(rows, RANK_STAGES)
    return rows.selectExpr(DATE, x, y).groupBy(DATE).agg(*_exprs({"ic": finite(Spark.corr(x, y)), "n": "count(*)"})).where("n >= 2 AND ic IS NOT NULL")


def _exprs(columns: dict):
    from pyspark.sql import functions as F

    return [F.expr(e(Spark) if callable(e) else e).alias(n) for n, e in columns.items()]


def daily_ic_sql(base: str, source: str, ranked: bool = False) -> str:
    x, y = ("factor_rank", "forward_rank") if ranked else ("factor", "forward")
    ranks = ", ".join(f"{e} AS {n}" for n, e in RANK_STAGES[0].items())
    return f"""WITH {base}, pairs AS (SELECT * FROM {source} WHERE factor IS NOT NULL AND forward IS NOT NULL), ranked AS (SELECT *, {ranks} FROM pairs),
ics AS (SELECT {DATE}, {finite(f'corr({x}, {y})')} AS ic, count(*) AS n FROM ranked GROUP BY {DATE}) SELECT * FROM ics WHERE n >= 2 AND ic IS NOT NULL"""


SUMMARY = {"ic_mean": "avg(ic)", "ic_std": "stddev_samp(ic)", "icir": "avg(ic) / nullif(stddev_samp(ic), 0)", "t_stat": "avg(ic) / nullif(stddev_samp(ic) / sqrt(CAST(count(ic) AS DOUBLE)), 0)", "n_dates": "count(ic)"}


def ic_summary(daily: DataFrame) -> DataFrame:
    """One row: mean, deviation, ratio, t statistic and its two-sided p-value."""
    out = daily.agg(*_exprs(SUMMARY))
    return out.withColumn("p_value", two_sided_p("t_stat", "n_dates"))


def turnover(df: DataFrame) -> DataFrame:
    """(trade_date, turnover): half the sum of absolute changes of weights; the first date has 0.

    If any value is negative, percent ranks are the weights; they sum to 1 on each date."""
    from pyspark.sql import functions as F

    sign = df.agg((F.coalesce(F.min("factor"), F.lit(0e0)) < 0).alias("signed"))
    rows = df.select(KEY, DATE, "factor").join(F.broadcast(sign))
    return apply(rows, TURNOVER).groupBy(DATE).agg(F.expr("coalesce(sum(abs(change)), 0e0) / 2").alias("turnover"))


TURNOVER: list[Stage] = [
    {"share": f"CASE WHEN signed THEN ({average_rank('factor')}) / nullif(count(factor) OVER (PARTITION BY {DATE}), 0) ELSE factor END"},
    {"weight": f"share / nullif(sum(share) OVER (PARTITION BY {DATE}), 0)"},
    {"change": f"weight - lag(weight, 1) OVER (PARTITION BY {KEY} ORDER BY {DATE})"},
]


def turnover_sql(base: str, source: str) -> str:
    parts, prev = [base, f"tv AS (SELECT {KEY}, {DATE}, factor, coalesce((SELECT min(factor) FROM {source}), 0e0) < 0 AS signed FROM {source})"], "tv"
    for i, s in enumerate(TURNOVER):
        parts.append(f"tv{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in s.items())} FROM {prev})")
        prev = f"tv{i}"
    return f"WITH {', '.join(parts)} SELECT {DATE}, floor(CAST(coalesce(sum(abs(change)), 0e0) / 2 AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS turnover FROM {prev} GROUP BY {DATE}"


def group_stages(groups: int) -> list[Stage]:
    """Quantile group of each code on its date: how many distinct inner edges of percent ranks lie below its own."""
    part = f"OVER (PARTITION BY {DATE})"
    edges = [f"edge{i}" for i in range(1, groups)]
    fresh = lambda i: " AND ".join([f"edge{i} > low_rank", f"edge{i} < high_rank", *([f"edge{i} <> edge{i - 1}"] if i > 1 else [])])
    return [
        {"pct_rank": f"({average_rank('factor')}) / count(*) {part}"},
        {**{e: (lambda d, i=i: f"{d.pct('pct_rank', i / groups)} {part}") for i, e in enumerate(edges, 1)}, "low_rank": f"min(pct_rank) {part}", "high_rank": f"max(pct_rank) {part}"},
        {"bucket": " + ".join(f"CASE WHEN {fresh(i)} AND edge{i} < pct_rank THEN 1 ELSE 0 END" for i in range(1, groups))},
    ]


def group_returns(df: DataFrame, groups: int = 5) -> DataFrame:
    """(bucket, mean_return, n): mean forward return of quantile groups over all dates."""
    return apply(both(df), group_stages(groups)).groupBy("bucket").agg(*_exprs({"mean_return": "avg(forward)", "n": "count(*)"}))


def is_monotonic(df: DataFrame, groups: int = 5) -> DataFrame:
    """One row: whether group means only rise or only fall."""
    g = group_returns(df, groups).agg(*_exprs({"a": "array_sort(collect_list(struct(bucket, mean_return)))"}))
    step = lambda op: f"forall(sequence(2, greatest(size(a), 2)), i -> size(a) < 2 OR element_at(a, i).mean_return {op} element_at(a, i - 1).mean_return)"
    return g.selectExpr(f"({step('>=')}) OR ({step('<=')}) AS monotonic")


SIDES = {"top": "avg(CASE WHEN bucket = high_bucket THEN forward END)", "bottom": "avg(CASE WHEN bucket = 0 THEN forward END)"}


def long_short(df: DataFrame, groups: int = 5) -> DataFrame:
    """(trade_date, spread): mean return of the top group less the bottom group's, a missing side as 0."""
    rows = apply(both(df), group_stages(groups)).selectExpr("*", f"{groups - 1} AS high_bucket")
    return rows.groupBy(DATE).agg(*_exprs(SIDES)).selectExpr(DATE, "coalesce(top, 0e0) - coalesce(bottom, 0e0) AS spread")


def groups_sql(base: str, source: str, what: str, groups: int = 5) -> str:
    parts, prev = [base, f"gp AS (SELECT * FROM {source} WHERE factor IS NOT NULL AND forward IS NOT NULL)"], "gp"
    for i, s in enumerate(group_stages(groups)):
        parts.append(f"gp{i} AS (SELECT *, {', '.join(f'{e(Duck) if callable(e) else e} AS {n}' for n, e in s.items())} FROM {prev})")
        prev = f"gp{i}"
    if what == "groups":
        return f"WITH {', '.join(parts)} SELECT bucket, floor(CAST(avg(forward) AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS mean_return, count(*) AS n FROM {prev} GROUP BY bucket"
    top = SIDES["top"].replace("high_bucket", str(groups - 1))
    if what == "raw":
        return f"WITH {', '.join(parts)} SELECT {DATE}, coalesce({top}, 0e0) - coalesce({SIDES['bottom']}, 0e0) AS spread FROM {prev} GROUP BY {DATE}"
    return f"WITH {', '.join(parts)} SELECT {DATE}, floor(CAST(coalesce({top}, 0e0) - coalesce({SIDES['bottom']}, 0e0) AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE) AS spread FROM {prev} GROUP BY {DATE}"


def long_short_summary(spread: DataFrame) -> DataFrame:
    """One row: total return, mean, deviation and yearly Sharpe ratio of the spreads."""
    from pyspark.sql import functions as F

    return spread.agg((F.product(F.col("spread") + 1) - 1).alias("total_return"), F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("std"), F.expr(f"avg(spread) / nullif(stddev_samp(spread), 0) * {math.sqrt(PERIODS)!r}").alias("sharpe"))


def report_numbers(df: DataFrame, groups: int = 5) -> dict:
    """All analyses of one factor: its values are worked out once and kept while the small aggregates run over them."""
    rows = df.select(KEY, DATE, "factor", "forward").persist()
    row = lambda d: d.first().asDict()
    try:
        means = [r.asDict() for r in group_returns(rows, groups).orderBy("bucket").collect()]
        ups = [b["mean_return"] - a["mean_return"] for a, b in zip(means[:-1], means[1:])]
        return {
            "ic": row(ic_summary(daily_ic(rows))),
            "rank_ic": row(ic_summary(daily_ic(rows, True))),
            "turnover": row(turnover(rows).agg(*_exprs({"mean_turnover": "avg(turnover)"}))),
            "groups": {"monotonic": all(u >= 0 for u in ups) or all(u <= 0 for u in ups), "mean_return": means},
            "long_short": row(long_short_summary(long_short(rows, groups))),
        }
    finally:
        rows.unpersist()


def report(df: DataFrame, groups: int = 5) -> str:
    """Summary of all analyses as JSON text; a handful of numbers leave the cluster."""
    return json.dumps(report_numbers(df, groups), default=float)
