"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors get one coordinate more, sqrt(M^2 - |x|^2) with M the greatest norm, and
queries are scaled to norm M, so the largest inner product is the least
distance.  A few Gaussian (2-stable) projections keep distances in law: a
point at distance d lies at a projected distance with square d^2 * chi^2(m).  A
kd-tree over the projections has leaves of bounded size; its splits are medians
of a bounded sample, but every vector is in the index.

A query takes the leaves in the order of their boxes' projected distances, a few
in the first wave and four times as many in each next one.  After a wave its
k-th best distance d_k is that much nearer; it goes on, verifying points by
their true inner products, until the next leaf - or, in a leaf, the next point -
is so far off in projection that a true neighbour within d_k lies nearer with
probability CONFIDENCE (the chi-square stopping test).  So each true neighbour
is found with about that probability or more.

A wave first lists which query visits which leaf.  A leaf's points are copied
only as often as its own visits need blocks of QUERY_BLOCK queries, and a leaf of
more than PART points is dealt to parts, so that a task's work is bounded
whatever the input.  The driver holds the tree and the boxes: MOST_LEAVES at most.

Equal vectors are one point of the index with its k + 1 smallest ids, which is
all that any answer can show of it.

Edge cases: vectors that are null, zero, or have null or non-finite components
take no part, nor rows with a null id; shorter vectors count as filled up with
zeros to the longest; a repeated vec_id counts once, with the least of its
vectors; fewer candidates than k give as many; tables without vectors or queries
give no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, small_batches, stage, table

K = 20
PROJECTIONS = 8
CONFIDENCE = 0.97
#: Points of a leaf, about; leaves at most; points whose medians split the tree; points of a leaf in one task, about.
LEAF, MOST_LEAVES, SAMPLE, PART = 2048, 16_384, 50_000, 8192
#: Leaves that a query takes before the test is asked, and how many times more by the next wave; queries that meet a leaf in one piece of work.
FIRST_LEAVES, MORE, QUERY_BLOCK = 2, 4, 4096
SEED = 7


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi^2(m) <= x) = p, by the series of the incomplete gamma function."""

    def below(x: float) -> float:
        a, y = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= y / n
            total += term
        return total * math.exp(-y + a * math.log(y) - math.lgamma(a))

    lo, hi = 1e-9, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Tree:
    """Median splits in heap order over projected points."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(max(1, (1 << depth) - 1), dtype=np.int64)
        self.at = np.full(len(self.dim), np.inf)
        groups = [np.arange(len(points))]
        for level in range(depth):
            below = []
            for i, g in enumerate(groups):
                node = (1 << level) - 1 + i
                if len(g):
                    some = points[g]
                    d = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
                    self.dim[node], self.at[node] = d, np.median(some[:, d])
                right = points[g, self.dim[node]] > self.at[node]
                below += [g[~right], g[right]]
            groups = below

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dim[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of a list column as an array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _lists(x: np.ndarray, kind) -> pa.Array:
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1), kind))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, one a vec_id, all of the greatest length, in floats or doubles as they are given."""
    v, number = F.col("embedding"), "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{number}>").alias("v"))
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        rows = rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0).cast(number), sizes["most"] - F.size("v"))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def index_points(rows: DataFrame, asked, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cid, asked, v, norm2) of each distinct vector, and for vectors that several rows share
    (cid, ids): the k + 1 smallest, and (vec_id, cid) of those that are queries."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    points = rows.groupBy("v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.max(asked(F.col("vec_id"))).alias("asked"))
    points = stage(points.select("cid", "n", "asked", "v", norm2.alias("norm2")), "points")
    shared = rows.join(points.where("n > 1").select("v", "cid"), "v").select("cid", "vec_id")
    # the ids of a very common vector are cut down in salted parts first
    part = Window.partitionBy("cid", "salt").orderBy("vec_id")
    few = shared.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("i", F.row_number().over(part)).where(F.col("i") <= k + 1)
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    ids = few.groupBy("cid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return points.drop("n"), stage(ids, "ids"), stage(shared.where(asked(F.col("vec_id"))).select("vec_id", "cid"), "askers")


def search(vectors: DataFrame, asked, k: int = K, m: int = PROJECTIONS, confidence: float = CONFIDENCE, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose vec_id satisfies asked, itself left out."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stage(valid(vectors), "vectors")
    kind = dict(rows.dtypes)["v"]
    numbers = pa.float32() if kind == "array<float>" else pa.float64()
    points, ids, askers = index_points(rows, asked, k)
    size = points.agg(F.count("*").alias("n"), F.max("norm2").alias("m2"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most, d = float(size["m2"]) * (1 + 1e-12), size["d"]
    stable = np.random.default_rng(SEED).normal(size=(d + 1, m))
    limit = chi_square_quantile(confidence, m)

    def project(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]], axis=1) @ stable

    def project_query(x: np.ndarray) -> np.ndarray:
        return x * (math.sqrt(most) / np.sqrt((x * x).sum(axis=1)))[:, None] @ stable[:d]

    depth = max(0, min(math.ceil(math.log2(max(1.0, size["n"] / leaf))), int(math.log2(MOST_LEAVES))))
    sample = points.orderBy(F.xxhash64("cid"), "cid").select("v").limit(SAMPLE).toArrow()
    tree = Tree(project(matrix(sample.column("v"))), depth)

    def place(batches):
        for batch in batches:
            p = project(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(p).astype(np.int32)), *batch.columns, _lists(p, pa.float64())], ["leaf", "cid", "v", "p"])

    placed = stage(points.select("cid", "v").mapInArrow(place, f"leaf int, cid long, v {kind}, p array<double>"), "leaves")
    lows, highs = [F.min(F.element_at("p", i + 1)) for i in range(m)], [F.max(F.element_at("p", i + 1)) for i in range(m)]
    boxes = placed.groupBy("leaf").agg(F.array(*lows).alias("lo"), F.array(*highs).alias("hi"), F.count("*").alias("n")).orderBy("leaf").toArrow()  # MOST_LEAVES rows at most
    names, lo, hi = boxes.column("leaf").to_numpy(), matrix(boxes.column("lo")), matrix(boxes.column("hi"))
    parts = spark.createDataFrame([(int(b), max(1, -(-int(n) // PART))) for b, n in zip(names, boxes.column("n").to_numpy())], "of int, parts int")

    def visits(first: int, last: int):
        """Which query takes which leaf, of those that come first-th to last-th in its order."""

        def each(batches):
            for batch in batches:
                all_v = matrix(batch.column(1))
                all_reach, all_least = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
                for s in range(0, batch.num_rows, 64):  # 64 queries by all leaves at once
                    v, reach, least = all_v[s : s + 64], all_reach[s : s + 64], all_least[s : s + 64]
                    p = project_query(v)
                    far = np.zeros((len(v), len(names)))
                    for j in range(m):
                        far += np.square(np.maximum(np.maximum(lo[None, :, j] - p[:, j : j + 1], p[:, j : j + 1] - hi[None, :, j]), 0))
                    at = np.argsort(far, axis=1, kind="stable")[:, first:last]
                    q, i = np.nonzero(np.take_along_axis(far, at, axis=1) <= reach[:, None])
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(names[at[q, i]].astype(np.int32)), batch.column(0).take(pa.array(q + s)), _lists(v[q].astype(numbers.to_pandas_dtype()), numbers), pa.array(reach[q]), pa.array(least[q])], ["leaf", "qid", "q", "reach", "least"])

        return each

    visit_schema = f"leaf int, qid long, q {kind}, reach double, least double"
    keep = k + 1

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"qid": [], "cid": [], "score": []}
        if left.num_rows and right.num_rows:
            x, cid = matrix(left.column("v")), left.column("cid").to_numpy()
            p = project(x)
            all_q, reach, qid = matrix(right.column("q")), right.column("reach").to_numpy(), right.column("qid").to_numpy()
            least = right.column("least").to_numpy()  # what has been found already: less is of no use
            for lo_ in range(0, len(qid), 256):
                q, near = all_q[lo_ : lo_ + 256], reach[lo_ : lo_ + 256]
                pq = project_query(q)
                off = (pq * pq).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * pq @ p.T
                got = q @ x.T
                got[off > near[:, None] + 1e-9] = -np.inf  # beyond the stopping test
                n = min(keep + 4, got.shape[1])
                top = np.argpartition(-got, n - 1, axis=1)[:, :n]
                for i in range(len(q)):
                    t = top[i][np.isfinite(got[i, top[i]])]
                    exact = (q[i][None, :] * x[t]).sum(axis=1)
                    order = np.lexsort((cid[t], -exact))[:keep]
                    order = order[exact[order] >= least[lo_ + i]]
                    out["qid"].append(np.full(len(order), qid[lo_ + i]))
                    out["cid"].append(cid[t[order]])
                    out["score"].append(exact[order])
        none = [np.empty(0, np.int64)]
        return pa.table({"qid": pa.array(np.concatenate(out["qid"] or none), pa.int64()), "cid": pa.array(np.concatenate(out["cid"] or none), pa.int64()), "score": pa.array(np.concatenate(out["score"] or none), pa.float64())})

    def wave(asking: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
        """The visits of a wave and what they find."""
        seen = stage(asking.mapInArrow(visits(first, last), visit_schema), "visits")
        work = seen.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")).join(F.broadcast(parts), F.col("leaf") == F.col("of")).drop("of")
        work = F.broadcast(work)  # MOST_LEAVES rows at most
        left = placed.select("leaf", "cid", "v").join(work, "leaf").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        left = left.select("leaf", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cid", "v")
        right = seen.join(work, "leaf").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
        right = right.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "qid", "q", "reach", "least")
        keys = ("leaf", "part", "block")
        return seen, left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(verify, "qid long, cid long, score double")

    queries = points.where("asked").select(F.col("cid").alias("qid"), "v")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asking = queries.select("qid", "v", F.lit(float("inf")).alias("reach"), F.lit(float("-inf")).alias("least"))
    found, first, last = None, 0, FIRST_LEAVES
    while first < len(names):  # as many rounds as the logarithm of the number of leaves
        seen, more = wave(asking, first, last)
        if seen.isEmpty():
            break
        both = more if found is None else found.union(more)
        now = stage(both.withColumn("i", F.row_number().over(best)).where(F.col("i") <= keep).drop("i"), "found")
        release(seen, *([found] if found is not None else []))
        found, first, last = now, last, last * MORE
        # d_k^2 = 2 M^2 - 2 s M / |q| of the last of k + 1 points so far
        worst = found.groupBy("qid").agg(F.min("score").alias("s"), F.count("*").alias("n"))
        d2 = F.lit(2 * most) - 2 * F.col("s") * F.lit(math.sqrt(most)) / length
        full = F.coalesce(F.col("n") >= keep, F.lit(False))
        reach = F.when(full, F.greatest(d2, F.lit(0.0)) * F.lit(limit)).otherwise(F.lit(float("inf")))
        least = F.when(full, F.col("s")).otherwise(F.lit(float("-inf")))
        asking = queries.join(worst, "qid", "left").select("qid", "v", reach.alias("reach"), least.alias("least"))
    release(placed)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    flat = found.join(ids, "cid", "left").select("qid", "score", F.explode(F.coalesce("ids", F.array("cid"))).alias("vec_id"))
    flat = flat.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("i") <= keep).drop("i")
    # answers of equal queries differ only in the query's own id
    own = rows.where(asked(F.col("vec_id"))).select("vec_id").join(askers, "vec_id", "left").select(F.col("vec_id").alias("query_id"), F.coalesce("cid", "vec_id").alias("qid"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = own.join(flat, "qid").where("query_id <> vec_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
