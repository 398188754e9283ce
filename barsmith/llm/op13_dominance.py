"""Dominance counting on a quantile grid with a suffix summed-area table.

A point is above another if its x is smaller and its y strictly larger.  Points
are dealt by range twice: by (x, y) into row strips, by (y, x) into column
strips.  A row strip holds smaller keys than the next one, a column strip too;
with these tie-breaks a point of an earlier row strip and a later column strip is
always above, whatever values both borders share, so strips may cut through a
value and stay even however many points have it.  For a point in row strip i and
column strip j the points above it are

  whole cells    all of rows before i and columns after j: one entry of the table
                 T[i, j], the cell counts summed up along i and down along j
  column strip   of j, in rows before i, with larger y
  row strip      of i, with smaller x and larger y

so each is counted once.  T is built by two windows over the cells, whose groups
are one row or one column of the grid.  A strip is swept by itself: ranks by y
are split bit by bit, and a zero bit counts the ones before it in its block.

Strips hold STRIP points, or 2 * sqrt(n) where that is more: the grid then has n / 4
cells at most and a task holds 2 million points, some 60 MB, of 10^12.  Nothing
else grows in a task.  The driver gets counts of one row and, as for any range
partitioning, Spark's sample of keys, 300 a strip and 3 million at most.

Edge cases: points with a null or not finite coordinate are above none and get null
counts; a null weight counts as 0, a null sale_id stands for one row; equal points are
not above each other and get equal counts; tables without rows give none; further
columns pass through ``count_above`` and are ignored by the query.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, small_batches, stage, table

#: Points of a strip (some megabytes in a task), as long as that is more than 2 * sqrt(n).
STRIP = 1 << 16


def above(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number and the weight of those with smaller a and strictly larger b."""
    m = len(a)
    order = np.lexsort((b, a))  # equal a by rising b, so that none before is larger
    rank = np.empty(m, np.int64)
    rank[np.lexsort((a, b))] = np.arange(m)  # equal b by rising a, so that none later is before
    y, w, at = rank[order], weight[order].astype(np.int64), order
    number, total = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for bit in range(max(m - 1, 0).bit_length() - 1, -1, -1):
        one = (y >> bit) & 1
        ones, heavy = (np.concatenate([[0], np.cumsum(v)]) for v in (one, one * w))
        start = (y >> (bit + 1)) << (bit + 1)  # a block holds all ranks that share the higher bits, from this place on
        before = ones[:-1] - ones[start]
        low = np.flatnonzero(one == 0)
        number[at[low]] += before[low]
        total[at[low]] += heavy[low] - heavy[start[low]]
        place = np.where(one == 1, start + (1 << bit) + before, np.arange(m) - before)
        y, w, at = (_put(v, place) for v in (y, w, at))
    return number, total


def _put(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[place] = values
    return out


def suffix_table(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """(_i, _j, t_n, t_w): number and weight of the cells in rows before _i and columns after _j, for the whole grid."""
    spark = cells.sparkSession
    zero = spark.range(rows * columns).selectExpr(f"CAST(id div {max(columns, 1)} AS INT) AS _i", f"CAST(id % {max(columns, 1)} AS INT) AS _j", "0L AS n", "0L AS w")
    dense = cells.select("_i", "_j", "n", "w").union(zero).groupBy("_i", "_j").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    right = Window.partitionBy("_i").orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.partitionBy("_j").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.select("_i", "_j", F.sum("n").over(right).alias("n"), F.sum("w").over(right).alias("w"))
    return dense.select("_i", "_j", F.coalesce(F.sum("n").over(upper), F.lit(0)).alias("t_n"), F.coalesce(F.sum("w").over(upper), F.lit(0)).alias("t_w"))


def count_above(points: DataFrame, x: str, y: str, weight: str, strip: int = STRIP) -> DataFrame:
    """points with n_above and w_above: how many lie above each, and the sum of their weights.

    x and y are whole numbers or doubles, weight a whole number."""
    spark, names = points.sparkSession, points.columns
    small_batches(spark)
    fits = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf") if dict(points.dtypes)[c] in ("double", "float") else F.lit(True)) for c in (x, y)]
    sound = F.coalesce(fits[0] & fits[1] & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
    known = points.where(sound).withColumn(weight, F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")))
    n = known.count()
    parts = max(1, -(-n // max(strip, 2 * isqrt(n))))
    # rows that are alike in all else differ in _tie, so that they can be dealt to several strips
    known = known.withColumn("_tie", F.pmod(F.monotonically_increasing_id(), F.lit(32768)).cast("int"))
    by_x = stage(known.repartitionByRange(parts, x, y, "_tie").withColumn("_i", F.spark_partition_id()), "by_x")
    kinds = ", ".join(f"`{c}` {k}" for c, k in by_x.dtypes if c != "_tie")
    kept = [c for c in by_x.columns if c != "_tie"]

    def column_strip(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            number, total = above(*(t.column(c).to_numpy() for c in ("_i", y, weight)))
            t = t.select([*kept, "_j"]).append_column("c_n", pa.array(number)).append_column("c_w", pa.array(total))
            yield from t.to_batches()

    by_y = by_x.repartitionByRange(parts, y, x, "_tie").withColumn("_j", F.spark_partition_id())
    by_y = stage(by_y.mapInArrow(column_strip, f"{kinds}, _j int, c_n long, c_w long"), "by_y")
    release(by_x)
    cells = stage(by_y.groupBy("_i", "_j").agg(F.count("*").alias("n"), F.sum(weight).alias("w")), "cells")
    size = cells.agg(F.coalesce(F.max("_i") + 1, F.lit(0)).alias("i"), F.coalesce(F.max("_j") + 1, F.lit(0)).alias("j")).first()
    grid = suffix_table(cells, size["i"], size["j"])

    def row_strip(t: pa.Table, entries: pa.Table) -> pa.Table:
        number, total = above(*(t.column(c).to_numpy() for c in (x, y, weight)))
        j, at = t.column("_j").to_numpy(), entries.column("_j").to_numpy()
        for c, own, mine in (("n_above", number, "n"), ("w_above", total, "w")):
            whole = _put(entries.column(f"t_{mine}").to_numpy(), at)[j]
            t = t.append_column(c, pa.array(own + whole + t.column(f"c_{mine}").to_numpy()))
        return t.select([*names, "n_above", "w_above"])

    result = ", ".join(f"`{c}` {k}" for c, k in known.select(names).dtypes) + ", n_above long, w_above long"
    swept = by_y.groupBy("_i").cogroup(grid.groupBy("_i")).applyInArrow(row_strip, result)
    none = F.lit(None).cast("long")
    return swept.unionByName(points.where(~sound).withColumn(weight, F.col(weight).cast("long")).select(*names, none.alias("n_above"), none.alias("w_above")))


def minute(ts: str, kind: str) -> Column:
    """Whole minutes since 1970 of a time that is taken as UTC, whatever the session's zone."""
    if kind == "timestamp_ntz":  # its fields know no zone
        return F.expr(f"CAST(datediff(CAST({ts} AS DATE), DATE'1970-01-01') AS BIGINT) * 1440 + hour({ts}) * 60 + minute({ts})")
    return F.expr(f"CAST(floor(unix_seconds({ts}) / 60) AS BIGINT)")


def points(sales: DataFrame) -> DataFrame:
    """(sale_id, slot, level, weight) of every sale."""
    total = F.expr("CASE WHEN abs(total) < double('Infinity') AND NOT isnan(total) THEN floor(100D * total + 0.5D) END")
    crc = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")))
    return sales.select("sale_id", minute("sold_at", dict(sales.dtypes)["sold_at"]).alias("slot"), total.cast("long").alias("level"), (F.lit(1) + F.pmod(crc, F.lit(5))).cast("long").alias("weight"))


def op13_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sale_id, slot, level, n_sales, n_rows) of every sale: the sales of earlier slots with larger totals, and their rows."""
    counted = count_above(points(table(spark, sf_dir, "sales")), "slot", "level", "weight")
    return counted.select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))


#: crc32 from its rule: eight steps a byte.
_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: xor(a >> 1, 3988292384 * (a & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(sale_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {_STEP}), 4294967295)"
ORACLE = f"""WITH p AS (SELECT row_number() OVER () AS id, sale_id, floor(epoch(sold_at) / 60)::BIGINT AS slot, floor(100 * total + 0.5)::BIGINT AS level, 1 + {_CRC} % 5 AS weight FROM sales),
pairs AS (SELECT a.id, count(*) AS n, sum(b.weight)::BIGINT AS w FROM p a JOIN p b ON b.slot < a.slot AND b.level > a.level GROUP BY a.id)
SELECT sale_id, slot, level, CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(n, 0) END AS n_sales, CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(w, 0) END AS n_rows
FROM p LEFT JOIN pairs USING (id)"""
