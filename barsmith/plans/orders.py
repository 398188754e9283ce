"""Replay of buy and sell orders that are carried out on the row after they are given.

An order puts all cash into a code's shares (1), all shares into cash (-1) or does nothing (0).  A loss beyond a
limit sells whatever the order says.  A code's rows follow one another, so each code is one task's fold; codes are
replayed side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY
from barsmith.plans.staged import rounded, shown, significant
from barsmith.sources import bars as source

#: Where orders are filled: columns of the price to buy and to sell at, and whether it slips.
FILLS = {"close": ("close", "close", True), "open": ("open", "open", True), "extreme": ("high", "low", False), "plain": ("close", "close", False)}
#: Factors of the rewards, and what an order takes from them.
PNL_FACTOR, DAILY_FACTOR, DOWNSIDE_FACTOR, PENALTY = 100.0, 0.1, 10.0, 0.05


def _trend(day: dict) -> float:
    """The market's log return while held, against it while not."""
    return day["log_return"] if day["was_held"] else -day["log_return"]


def _pnl(day: dict) -> float:
    return PNL_FACTOR * day["gain"]


def _downside(day: dict) -> float:
    """A small part of the day's gain, and on a sale the trade's return over the deviation of its falling days."""
    bonus = 0.0
    if day["sold"]:
        whole = day["close"] / day["entry"] - 1
        falls = [r for r in day["returns"] if r < 0]
        spread = float(np.std(falls)) if len(falls) > 1 else 0.0
        bonus = whole / spread if spread > 1e-9 else max(whole, 0.0)
    return DAILY_FACTOR * day["gain"] + DOWNSIDE_FACTOR * bonus


REWARDS = {"trend": _trend, "pnl": _pnl, "downside": _downside}


def fold(close: np.ndarray, buy: np.ndarray, sell: np.ndarray, log_return: np.ndarray, order: np.ndarray, reward: str, cash: float, cost: float, stop: float) -> tuple[np.ndarray, ...]:
    """(value, held, order carried out, reward) of each row of one code; rows without a price change nothing."""
    value, shares, entry, returns = cash, 0.0, 0.0, []
    out = np.zeros((4, len(close)))
    out[0] = cash
    for t in range(1, len(close)):
        price, given = close[t], order[t - 1]
        if not price > 0:
            out[0, t], out[1, t] = value, shares > 0
            continue
        given = 0 if given != given else given
        if shares > 0 and price / entry - 1 < stop:
            given = -1
        was, before, bought_at = shares > 0, value, entry
        if given > 0 and cash > 0 and buy[t] > 0:
            shares, entry, cash = cash * (1 - cost) / buy[t], buy[t], 0.0
        elif given < 0 and shares > 0:
            cash, shares, entry = shares * sell[t] * (1 - cost), 0.0, 0.0
        value = cash + shares * price
        sold = was and shares == 0
        day = {"log_return": 0.0 if log_return[t] != log_return[t] else log_return[t], "was_held": was, "gain": value / before - 1 if before > 0 else 0.0, "sold": sold, "close": price, "entry": bought_at, "returns": returns}
        out[:, t] = value, shares > 0, given, REWARDS[reward](day) - (PENALTY if given else 0.0)
        returns = [*returns, day["log_return"]] if shares > 0 else []
    return tuple(out)


def replay_orders(orders: DataFrame, fill: str = "close", reward: str = "pnl", cash: float = 100_000.0, cost: float = 0.005, slippage: float = 0.005, stop: float = -0.05) -> DataFrame:
    """(ts_code, trade_date, value, held, executed, reward) of orders (ts_code, trade_date, open, high, low, close, log_return, order)."""
    at_buy, at_sell, slips = FILLS[fill]
    if reward not in REWARDS:
        raise ValueError(f"unknown reward {reward}")
    slip = slippage if slips else 0.0

    def each(t: pa.Table) -> pa.Table:
        t = t.sort_by(DATE)
        x = {c: t.column(c).to_numpy().astype(float) for c in ("open", "high", "low", "close", "log_return", "order")}
        value, held, executed, got = fold(x["close"], x[at_buy] * (1 + slip), x[at_sell] * (1 - slip), x["log_return"], x["order"], reward, cash, cost, stop)
        return pa.table([t.column(KEY), t.column(DATE), pa.array(value), pa.array(held > 0), pa.array(executed.astype(np.int32)), pa.array(got)], names=[KEY, DATE, "value", "held", "executed", "reward"])

    rows = orders.select(KEY, DATE, "open", "high", "low", "close", "log_return", F.col("order").cast("double").alias("order"))
    return rows.groupBy(KEY).applyInArrow(each, f"{KEY} string, {DATE} date, value double, held boolean, executed int, reward double")


# --- queries -----------------------------------------------------------------------------------------------------


def _orders(s, d):
    """Bought after a rise, sold after a fall."""
    p = source.panel(s, d).selectExpr("*", "CASE WHEN log_return > 0 THEN 1 WHEN log_return < 0 THEN -1 ELSE 0 END AS order")
    return replay_orders(p).selectExpr(KEY, DATE, f"{significant('value')} AS value", "CAST(held AS INT) AS held", "executed", f"{shown('reward', 5)} AS reward")


#: The same as a recursion over a code's rows.
_ORDERS_SQL = f"""WITH RECURSIVE {source.panel_sql()}, p AS (SELECT {KEY}, {DATE}, close, lag(CASE WHEN log_return > 0 THEN 1 WHEN log_return < 0 THEN -1 ELSE 0 END) OVER w AS told, row_number() OVER w AS n FROM panel WINDOW w AS (PARTITION BY {KEY} ORDER BY {DATE})),
s AS (SELECT {KEY}, {DATE}, n, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS entry, 100000.0::DOUBLE AS value, 0 AS executed, 0.0::DOUBLE AS reward FROM p WHERE n = 1 UNION ALL
  SELECT {KEY}, {DATE}, n, c, h, e, v, done, CASE WHEN close > 0 THEN 100 * (v / value - 1) - CASE WHEN done <> 0 THEN 0.05 ELSE 0 END ELSE 0 END FROM (SELECT *, CASE WHEN close > 0 THEN c + h * close ELSE value END AS v
    FROM (SELECT *, CASE WHEN done = 1 AND cash > 0 THEN 0 WHEN done = -1 AND shares > 0 THEN shares * close * 0.995 * 0.995 ELSE cash END AS c, CASE WHEN done = 1 AND cash > 0 THEN cash * 0.995 / (close * 1.005) WHEN done = -1 AND shares > 0 THEN 0 ELSE shares END AS h,
        CASE WHEN done = 1 AND cash > 0 THEN close * 1.005 WHEN done = -1 AND shares > 0 THEN 0 ELSE entry END AS e
      FROM (SELECT s.{KEY}, p.{DATE}, p.n, s.cash, s.shares, s.entry, s.value, p.close, CASE WHEN p.close > 0 THEN CASE WHEN s.shares > 0 AND p.close / s.entry - 1 < -0.05 THEN -1 ELSE p.told END ELSE 0 END AS done FROM s JOIN p ON p.{KEY} = s.{KEY} AND p.n = s.n + 1))))
SELECT {KEY}, {DATE}, {significant('value')} AS value, (shares > 0)::INT AS held, executed, {rounded('reward', 5)} AS reward FROM s"""
QUERIES = {"orders_replay": (_orders, _ORDERS_SQL)}
