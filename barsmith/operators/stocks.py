"""Instrument lists: filtering, fuzzy names, sorting and paging."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.plans.staged import rounded, shown

SORTABLE = ("symbol", "name", "market", "industry")


def likeness_bound(name: Column, wanted: str) -> Column:
    """An upper bound of name_likeness from the two multisets of characters alone: a match takes each of them once at most.

    It is a plain expression over the wanted text's distinct characters."""
    low, own = wanted.lower(), F.lower(name)
    common = sum((F.least(F.length(own) - F.length(F.replace(own, F.lit(c), F.lit(""))), F.lit(low.count(c))) for c in sorted(set(low))), F.lit(0))
    size = F.length(own) + len(low)
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, 0.0).otherwise(2.0 * common / size)


def name_likeness(name: Column, wanted: str) -> Column:
    """Ratcliff-Obershelp ratio of two names without regard to case, 0 to 1."""

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        low = wanted.lower()
        return names.map(lambda n: SequenceMatcher(None, low, n.lower()).ratio() if n else 0.0).astype(float)

    return ratio(name)


def alike(stocks: DataFrame, wanted: str, likeness: float) -> DataFrame:
    """Rows whose name contains a text or is alike enough.

    Two bounds come first and are plain expressions: lengths (2 * shorter / both) and common characters.  The exact ratio
    is worked out in Python for those names only that can reach the likeness and do not contain the text anyway."""
    low = wanted.lower()
    hit = F.coalesce(F.lower("name").contains(low), F.lit(False))
    both = F.length(F.lower("name")) + len(low)
    near = 2.0 * F.least(F.length(F.lower("name")), F.lit(len(low))) / both >= likeness
    marked = stocks.withColumn("_hit", hit)
    open_ = marked.where(~F.col("_hit") & near & (likeness_bound(F.col("name"), wanted) >= likeness))
    found = open_.where(name_likeness(F.col("name"), wanted) >= likeness)
    sure = F.lit(likeness <= 0)  # then every name is alike, missing ones too
    return marked.where(F.col("_hit") | sure).unionByName(found.where(~sure)).drop("_hit")


def find(stocks: DataFrame, market: str | None = None, industry: str | None = None, code: str | None = None, name: str | None = None, fuzzy: bool = True, likeness: float = 0.55) -> DataFrame:
    """Rows whose fields contain the given texts, whatever their case; names may also be alike."""
    for column, text in (("market", market), ("industry", industry), ("symbol", code)):
        if text:
            stocks = stocks.where(F.lower(column).contains(text.strip().lower()))
    if name:
        stocks = alike(stocks, name.strip(), likeness) if fuzzy else stocks.where(F.lower("name").contains(name.strip().lower()))
    return stocks


def page(stocks: DataFrame, number: int = 1, size: int = 10, sort_by: str | None = None, descending: bool = False) -> DataFrame:
    """One page of rows, each with the total number of rows found."""
    by = sort_by if sort_by in stocks.columns else "symbol"
    total = stocks.agg(F.count("*").alias("total"))
    order = [F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "symbol"]
    return stocks.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def supplier_list(spark, sf_dir: str) -> DataFrame:
    """Suppliers as a list of instruments."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("market"), F.col("r_name").alias("industry"))


_LIST = "stocks AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, s_name AS name, n_name AS market, r_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
def _bounded(spark, sf_dir: str) -> DataFrame:
    """Names that the bounds let through, and their number of all: the exact ratio sees no others."""
    rows = supplier_list(spark, sf_dir).select("symbol", "name", likeness_bound(F.col("name"), "suplier#000000001").alias("bound"))
    return rows.selectExpr("symbol", f"{shown('bound')} AS bound", "bound >= 0.9 AS open")


_COMMON = " + ".join(f"least(len(lower(name)) - len(replace(lower(name), '{c}', '')), {'suplier#000000001'.count(c)})" for c in sorted(set("suplier#000000001")))
QUERIES = {
    "stocks_page": (lambda s, d: page(find(supplier_list(s, d), industry="a"), 2, 7, "market", True), f"WITH {_LIST}, f AS (SELECT * FROM stocks WHERE contains(lower(industry), 'a')) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY market DESC NULLS LAST, symbol LIMIT 7 OFFSET 7"),
    "stocks_fuzzy": (lambda s, d: find(supplier_list(s, d), name="suplier#000000001", likeness=0.9), None),
    "stocks_fuzzy_bound": (_bounded, f"WITH {_LIST}, b AS (SELECT symbol, 2.0::DOUBLE * ({_COMMON}) / (len(name) + {len('suplier#000000001')}) AS bound FROM stocks) SELECT symbol, {rounded('bound')} AS bound, bound >= 0.9 AS open FROM b"),
}
