"""Daily bars: derived panels, dense calendars, readers, writers and upserts."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY

FIELDS = ("open", "high", "low", "close", "vol", "amount")
#: The full layout of a long bar table.
BAR_SCHEMA = f"{KEY} string, {DATE} date, pre_close double, open double, high double, low double, close double, change double, pct_chg double, vol double, amount double"


def read(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None, codes: list[str] | None = None) -> DataFrame:
    """Bars from parquet, orc, csv or json; columns and codes reach the scan.  Dates may be dates or yyyyMMdd text."""
    if fmt in ("xlsx", "pkl", "pickle"):
        raise ValueError(f"{fmt} is a single-machine format; convert it to parquet first")
    reader = spark.read
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if columns:
        df = df.select(*columns)
    if codes is not None:
        df = df.where(F.col(KEY).isin(codes))
    if DATE in df.columns and dict(df.dtypes)[DATE] == "string":
        day = F.coalesce(F.to_date(F.when(F.length(DATE) == 8, F.col(DATE)), "yyyyMMdd"), F.expr(f"try_cast({DATE} AS date)"))
        df = df.withColumn(DATE, day)
    for c in set(df.columns) & {*FIELDS, "pre_close", "change", "pct_chg"}:
        df = df.withColumn(c, nan_to_null(F.expr(f"try_cast(`{c}` AS double)")))
    return df


def read_many(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Union of series tables by name, missing columns null, with the file each row came from."""
    parts = [read(spark, p, fmt).withColumn("source_file", F.col("_metadata.file_name")) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_dir(spark: SparkSession, folder: str, names: str = "*.parquet", without: tuple[str, ...] = (), fmt: str = "parquet") -> DataFrame:
    """Bars of all files of a folder whose names match a pattern and hold none of some texts.

    Patterns reach the file listing; one scan reads all files, whose columns are merged by name."""
    df = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).option("mergeSchema", True).format(fmt).load(folder)
    df = df.withColumn("source_file", F.col("_metadata.file_name"))
    for part in without:
        df = df.where(~F.col("source_file").contains(part))
    return df


def write(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def nan_to_null(c: Column) -> Column:
    """A number, null where it is not one or not finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def normalise(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename vendor columns, coerce numbers (errors become null), parse days, drop rows without keys, order by day.

    names: vendor name -> our name."""
    for old, new in names.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    for c in df.columns:
        if c not in (KEY, DATE, "name"):
            df = df.withColumn(c, nan_to_null(F.expr(f"try_cast(`{c}` AS double)")))
    return df.withColumn(DATE, F.expr(f"try_cast({DATE} AS date)")).dropna(subset=[c for c in (KEY, DATE) if c in df.columns]).sort(DATE)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = (KEY, DATE)) -> DataFrame:
    """Rows of both; of equal keys the new one stays."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_seq"))
    return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_seq")


def keep_one(rows: DataFrame, keys: tuple[str, ...] = (KEY, DATE)) -> DataFrame:
    """One row of each key: of several the one with the largest values, so that reruns agree."""
    rest = [F.desc_nulls_last(c) for c in rows.columns if c not in keys]
    one = Window.partitionBy(*keys).orderBy(*rest) if rest else Window.partitionBy(*keys).orderBy(*keys)
    return rows.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def replace_table(df: DataFrame, path: str, backup: bool = True, partition_by: list[str] | None = None) -> str | None:
    """Write df beside a table and put it in the table's place; returns where the old table stays, if it does.

    df may read from the very table: its files stand until the new ones are whole, and what breaks off before
    the two renames leaves the table as it was.  Between them there is a moment without a table; ``stored`` keeps
    tables that are whole at every moment."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    write(df, fresh, "errorifexists", partition_by)
    fs, target = _hadoop(spark, path)
    there = fs.exists(target)
    if there and not fs.rename(target, _hadoop(spark, old)[1]):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(_hadoop(spark, fresh)[1], target):
        if there:
            fs.rename(_hadoop(spark, old)[1], target)
        raise OSError(f"{path} could not be replaced; it stands as before")
    if there and not backup:
        fs.delete(_hadoop(spark, old)[1], True)
    spark.catalog.refreshByPath(path)
    return old if there and backup else None


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: tuple[str, ...] = (KEY, DATE), backup: bool = True) -> str | None:
    """Upsert rows into a stored table, with a backup of what it held before."""
    fs, target = _hadoop(spark, path)
    return replace_table(upsert(spark.read.parquet(path), new, keys) if fs.exists(target) else new, path, backup)


def fetch_window(last: date | None, last_trading_day: date, start: date, overlap_days: int = 5, force: bool = False) -> tuple[str, date | None]:
    """What an incremental fetch of one code has to ask for: ('skip' | 'incremental' | 'full', first day)."""
    if force or last is None:
        return "full", start
    if last >= last_trading_day:
        return "skip", None
    return "incremental", max(start, last - timedelta(days=overlap_days))


def date_ranges(start: date, end: date, years: int = 1) -> list[tuple[date, date]]:
    """Consecutive closed ranges of so many calendar years that cover start to end."""
    out, first = [], start
    while first <= end:
        last = min(end, date(first.year + years - 1, 12, 31))
        out.append((first, last))
        first = last + timedelta(days=1)
    return out


def code_with_market(code: Column) -> Column:
    """Six-digit codes get their market's suffix by the first digit; others stay."""
    code = F.trim(code)
    return F.when(code.contains("."), F.upper(code)).when(code.rlike("^[659]"), F.concat(code, F.lit(".SH"))).when(code.rlike("^[84]"), F.concat(code, F.lit(".BJ"))).otherwise(F.concat(code, F.lit(".SZ")))


def events_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short, wide panel: a code for each user, a bar for each day of its events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    at = F.struct("ts", "event_id")
    code = F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    bars = e.groupBy(code.alias(KEY), F.to_date("ts").alias(DATE))
    return bars.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("vol"), F.sum("value").alias("amount"))


EVENTS_BARS = f"""bars AS (
  SELECT 'U' || lpad(user_id::VARCHAR, 6, '0') AS {KEY}, ts::DATE AS {DATE}, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS vol, sum(value) AS amount FROM events GROUP BY 1, 2)"""


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, narrow panel: a code for each return flag, a bar for each ship date."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    price = F.col("l_extendedprice") / F.col("l_quantity")
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*names, "l_quantity", "l_returnflag", "l_shipdate").withColumn("p", price)
    at = F.struct(*names)
    bars = d.groupBy(F.col("l_returnflag").alias(KEY), F.to_date("l_shipdate").alias(DATE))
    return bars.agg(F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("amount"))


_AT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINEITEM_BARS = f"""bars AS (
  SELECT l_returnflag AS {KEY}, l_shipdate::DATE AS {DATE}, first(l_extendedprice / l_quantity ORDER BY {_AT}) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_AT}) AS close, sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY 1, 2)"""


def with_returns(bars: DataFrame) -> DataFrame:
    """Add pre_close (the code's bar before), log_return and simple_return."""
    before = Window.partitionBy(KEY).orderBy(DATE)
    if "pre_close" not in bars.columns:
        bars = bars.withColumn("pre_close", F.lag("close").over(before))
    sound = (F.col("close") > 0) & (F.col("pre_close") > 0)
    return bars.withColumn("log_return", F.when(sound, F.ln(F.col("close") / F.col("pre_close")))).withColumn("simple_return", F.expr("close / nullif(pre_close, 0) - 1"))


def trading_days(rows: DataFrame) -> list[date]:
    """The distinct days of a table, in order: one column is read, thousands of days at most come back."""
    return [r[0] for r in rows.select(DATE).distinct().where(F.col(DATE).isNotNull()).orderBy(DATE).collect()]


def densify(bars: DataFrame, dates: DataFrame | list[date] | None = None) -> DataFrame:
    """A row for each code and trading date, null where a code has no bar.

    A bar lays out the dates up to its code's next bar (the first one those before it as well), from one
    array of days (thousands at most) that is part of the plan: bars are read and dealt by code once, as for
    any other window, and no grid of codes and dates is made or joined.  Rows whose date is not in the
    calendar go; repeated rows stay."""
    spark = bars.sparkSession
    days = dates if isinstance(dates, list) else trading_days(bars if dates is None else dates)
    if not days:
        return bars.limit(0)
    places = spark.createDataFrame([(i + 1, d) for i, d in enumerate(days)], "_at int, _day date")
    own = [c for c in bars.columns if c not in (KEY, DATE)]
    w = Window.partitionBy(KEY).orderBy(DATE)
    rows = bars.join(F.broadcast(places), F.col(DATE) == F.col("_day")).drop("_day")
    rows = rows.withColumn("_next", F.lead("_at").over(w)).withColumn("_first", F.lag("_at").over(w).isNull())
    start = F.when(F.col("_first"), 1).otherwise(F.col("_at"))
    until = F.greatest(F.coalesce(F.col("_next"), F.lit(len(days) + 1)), F.col("_at") + 1)
    rows = rows.select(KEY, F.col(DATE).alias("_own"), *own, F.explode(F.slice(F.lit(days).cast("array<date>"), start, until - start)).alias(DATE))
    here = F.col(DATE) == F.col("_own")
    return rows.select(KEY, DATE, *(F.when(here, F.col(c)).alias(c) for c in own))


def panel(spark: SparkSession, sf_dir: str, kind: str = "events") -> DataFrame:
    """Dense panel with returns of one of the derived bar tables."""
    if kind == "events":
        bars, days = events_bars(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias(DATE))
    else:
        bars, days = lineitem_bars(spark, sf_dir), spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias(DATE))
    return densify(with_returns(bars), days).select(KEY, DATE, *FIELDS, "pre_close", "log_return")


def panel_sql(kind: str = "events") -> str:
    """Common table expressions that end in one named panel."""
    return f"""{EVENTS_BARS if kind == 'events' else LINEITEM_BARS},
priced AS (SELECT *, lag(close) OVER (PARTITION BY {KEY} ORDER BY {DATE}) AS pre_close FROM bars),
returned AS (SELECT *, CASE WHEN close > 0 AND pre_close > 0 THEN ln(close / pre_close) END AS log_return FROM priced),
panel AS (SELECT c.{KEY}, d.{DATE}, open, high, low, close, vol, amount, pre_close, log_return
  FROM (SELECT DISTINCT {KEY} FROM bars) c CROSS JOIN (SELECT DISTINCT {DATE} FROM bars) d
  LEFT JOIN returned r ON r.{KEY} = c.{KEY} AND r.{DATE} = d.{DATE})"""
