"""Bars as a stream: ticks to daily bars, duplicates within a watermark, and state that goes on from bar to bar."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barsmith.functions.dialect import DATE, KEY


def read_ticks(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """A stream of parquet files with ticks, in the order they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def daily_bars(ticks: DataFrame, code: str, time: str, price: str, late: str = "2 days") -> DataFrame:
    """Finished bars of each code and day; a day closes once the watermark has passed it, later ticks are left out."""
    at = F.struct(time)
    day = F.window(time, "1 day")
    bars = ticks.withWatermark(time, late).groupBy(F.col(code).cast("string").alias(KEY), day)
    made = bars.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("vol"), F.sum(price).alias("amount"))
    return made.select(KEY, F.to_date("window.start").alias(DATE), "open", "high", "low", "close", "vol", "amount")


def distinct_ticks(ticks: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    return ticks.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def moving_ema(bars: DataFrame, span: int, price: str = "close") -> DataFrame:
    """(ts_code, trade_date, close, ema) of a stream of bars: each code's average lives in the state store.

    Bars of one code must come in order over triggers; within one they are sorted.  A missing price repeats the average."""
    alpha = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ema = state.get[0] if state.exists else float("nan")
        rows = pd.concat(list(batches)).sort_values(DATE)
        out = []
        for v in rows[price].to_numpy(float):
            if v == v:
                ema = v if ema != ema else alpha * v + (1 - alpha) * ema
            out.append(ema)
        state.update((ema,))
        yield pd.DataFrame({KEY: key[0], DATE: rows[DATE].values, price: rows[price].values, "ema": out})

    schema = f"{KEY} string, {DATE} date, {price} double, ema double"
    return bars.select(KEY, DATE, price).groupBy(KEY).applyInPandasWithState(step, schema, "ema double", "append", "NoTimeout")


LINES = ("EMA", "KDJ_K_3", "KDJ_D_3")


class DayLines(StatefulProcessor):
    """Exponential average and stochastic lines of each code, with bars that come late or come again.

    State of a code: its days that may still change, by day, and one row of what the closed days before them left
    (average, lines, highs and lows of the last window).  A batch puts its bars among the open days and gives the lines
    of every open day from the first changed one on, so a late bar also corrects the days after it.  A timer closes a
    day once the watermark has passed it: it is folded into the closed row.  Bars of closed days come too late."""

    def __init__(self, window: int, span: int):
        self.window, self.span = window, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day date", "close double, high double, low double")
        self.closed = handle.getValueState("closed", "day date, rows int, ema double, k double, d double, highs array<double>, lows array<double>")

    def _start(self):
        if self.closed.exists():
            day, rows, ema, k, d, highs, lows = self.closed.get()
            return day, rows, ema, k, d, list(highs), list(lows)
        return None, 0, None, 50.0, 50.0, [], []

    def _step(self, state, day, bar):
        """The state after one more day."""
        _, rows, ema, k, d, highs, lows = state
        close, high, low = bar
        highs, lows = [*highs, high][-self.window :], [*lows, low][-self.window :]
        if close is not None:
            alpha = 2 / (self.span + 1)
            ema = close if ema is None else alpha * close + (1 - alpha) * ema
        top, bottom = (f([v for v in x if v is not None], default=None) for f, x in ((max, highs), (min, lows)))
        if rows and close is not None and top is not None and bottom is not None:
            rsv = 50.0 if top == bottom else (close - bottom) / (top - bottom) * 100
            k = rsv / 3 + k * 2 / 3
            d = k / 3 + d * 2 / 3
        elif rows and top is not None and top == bottom:  # a window that stands still has its line in the middle
            k = 50.0 / 3 + k * 2 / 3
            d = k / 3 + d * 2 / 3
        return day, rows + 1, ema, k, d, highs, lows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._start()
        changed = None
        none = lambda v: None if pd.isna(v) else float(v)
        for pdf in rows:
            for day, close, high, low in zip(pdf[DATE], pdf["close"], pdf["high"], pdf["low"]):
                if state[0] is None or day > state[0]:
                    if not self.open.containsKey((day,)):
                        self.handle.registerTimer(_millis(day))
                    self.open.updateValue((day,), (none(close), none(high), none(low)))
                    changed = day if changed is None else min(changed, day)
        out = []
        if changed is not None:
            for (day,), bar in sorted(self.open.iterator(), key=lambda x: x[0]):
                state = self._step(state, day, bar)
                if day >= changed:
                    out.append((key[0], day, *state[2:5]))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        state = self._start()
        for (day,), bar in sorted(self.open.iterator(), key=lambda x: x[0]):
            if _millis(day) <= until:
                state = self._step(state, day, bar)
                self.open.removeKey((day,))
        if state[0] is not None:
            self.closed.update(state)
        yield _frame([])

    def close(self) -> None:
        pass


def _millis(day: date) -> int:
    return (day - date(1970, 1, 1)).days * 86_400_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[KEY, DATE, *LINES])
    return out.astype({n: "float64" for n in LINES})


def lines(bars: DataFrame, window: int, span: int | None = None, late: str = "5 days") -> DataFrame:
    """(ts_code, trade_date, EMA, KDJ_K_3, KDJ_D_3) of a stream of bars that may come out of order or again.

    A day is given anew whenever it or an open day before it changes; the last row of a day counts, as upsert_batches keeps
    it.  Days are final once the watermark, so long before the latest day, has passed them.  Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    marked = bars.select(KEY, DATE, "close", "high", "low", F.col(DATE).cast("timestamp").alias("at")).withWatermark("at", late)
    kinds = f"{KEY} string, {DATE} date, " + ", ".join(f"{n} double" for n in LINES)
    return marked.groupBy(KEY).transformWithStateInPandas(DayLines(window, span or window), kinds, "Update", "EventTime")


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, days: int = 5):
    """Start a query that writes each batch's bars to a table partitioned by month, replacing a month as a whole.

    The rows to be written are whole files in the stream's own checkpoint folder before they replace any, since
    they are read from the files that go: an executor that is lost on the way loses none."""
    from barsmith.sources.bars import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("month", F.date_format(DATE, "yyyy-MM")).persist()
        months = [r["month"] for r in new.select("month").distinct().collect()]  # few: a batch spans days
        if months:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
            both = upsert(spark.read.parquet(path).where(F.col("month").isin(months)), new) if there else new
            aside = f"{checkpoint.rstrip('/')}/batches/{number}"
            both.write.mode("overwrite").parquet(aside)
            spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
            kept = spark._jvm.org.apache.hadoop.fs.Path(aside)
            kept.getFileSystem(spark._jsc.hadoopConfiguration()).delete(kept, True)
        new.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
