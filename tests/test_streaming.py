"""Lines of a stream against the batch lines, however the bars come."""

import datetime as dt

import numpy as np
import pytest

from barsmith.operators import rolling
from barsmith.streaming import bars as streams

SCHEMA = "ts_code string, trade_date date, close double, high double, low double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def history(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for code in "AB":
        price = 50 + np.cumsum(rng.normal(size=24))
        for i, p in enumerate(price):
            gap = rng.random() < 0.1
            rows.append((code, day(i), None if gap else float(p), float(p + rng.random()), float(p - rng.random())))
    return rows


def run(spark, tmp_path, batches, window, late):
    path, name = str(tmp_path / "in"), f"lines_{abs(hash(str(tmp_path)))}"
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    got = {}

    def keep(df, number):
        got.update({(r["ts_code"], r["trade_date"]): tuple(r[n] for n in streams.LINES) for r in df.collect()})

    spark.createDataFrame([], SCHEMA).write.parquet(path)
    stream = streams.lines(spark.readStream.schema(SCHEMA).parquet(path), window, late=late)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).queryName(name).foreachBatch(keep).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
            q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if kept is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return got


def batch_lines(spark, rows, window):
    panel = spark.createDataFrame([(*r, 1.0, r[2]) for r in rows], f"{SCHEMA}, vol double, open double")
    out = rolling.with_state(panel, window).select("ts_code", "trade_date", *streams.LINES).collect()
    return {(r["ts_code"], r["trade_date"]): tuple(r[n] for n in streams.LINES) for r in out}


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        for a, b in zip(got[k], v):
            assert (a is None and b is None) or (a != a and b is None) or abs(a - b) < 1e-9, (k, got[k], v)


def test_shuffled_and_late_batches_give_the_batch_lines(spark, tmp_path):
    rows = history(1)
    rng = np.random.default_rng(2)
    order = sorted(rows, key=lambda r: (r[1] - day(0)).days + 4 * rng.random())  # up to four days late
    wrong = [(c, d, (x or 0) + 9.0, h + 20, low) for c, d, x, h, low in rows if d in (day(6), day(15))]  # comes first, is corrected later
    batches = [order[i : i + 9] for i in range(0, len(order), 9)]
    batches = [[*wrong[:1], *batches[0]], *batches[1:]]
    batches[2] = [*batches[2], *(r for r in rows if r[:2] == wrong[0][:2])]
    got = run(spark, tmp_path, batches, 5, "8 days")
    same(got, batch_lines(spark, rows, 5))


def test_closed_days_do_not_change(spark, tmp_path):
    rows = [("A", day(i), float(i), i + 1.0, i - 1.0) for i in range(12)]
    late = [("A", day(1), 99.0, 100.0, 98.0)]
    got = run(spark, tmp_path, [rows[:6], rows[6:], [("A", day(12), 5.0, 6.0, 4.0)], late, [("A", day(13), 5.0, 6.0, 4.0)]], 3, "2 days")
    same(got, batch_lines(spark, [*rows, ("A", day(12), 5.0, 6.0, 4.0), ("A", day(13), 5.0, 6.0, 4.0)], 3))
