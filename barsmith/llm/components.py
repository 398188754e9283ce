"""Connected components by alternating large and small stars, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root the smallest node it reaches; itself for roots.

    Each round hangs neighbours on the smallest of them; a hub's minimum is aggregated before the shuffle
    and its links meet it in a join that Spark can split, so no task needs all links of a hub."""
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == seen:
            break
        seen = (mark["n"], mark["h"])
        # large star: larger neighbours of a node go to its smallest neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        release(now)
        now = after
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
