"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a linear score g that
minimises  prior * E_p[(1 - g)^2] + max(0, E_u[(1 + g)^2] - prior * E_p[(1 + g)^2]).
With this loss the unlabelled part depends only on the means and second moments
of the features, which are summed over all unlabelled rows, however many; the
solution is that of a linear system, and while its second term is below zero its
gradient is climbed back, as the non-negative estimator asks.

Neither the class prior nor the scale of the scores sees a negative label.  The
prior is the least ratio of unlabelled to positive rows above a threshold of a
first score, with a confidence term (best bin estimation); positives are scored
by a model that has not seen them (two folds).  Slope and shift of the final
logistic score minimise the unbiased logistic risk of positives and unlabelled
rows, over a histogram of all unlabelled scores.

Features are rates of hashed byte pairs and a few counts over the whole text
(repeats, case, digits, symbols, lines), held in 16 bits in training and in
scoring alike.  Every row that is not held out counts as unlabelled; only the
positives are a sample: at most SAMPLE of them, chosen by a hash of doc_id.

Edge cases: null or empty texts get the score of a text without features; rows
with a null doc_id are scored and count as held out; a doc_id that is labelled
more than once is positive if any label says so; without a positive label every
score is 1; an empty table gives an empty one; further columns of the input stay in
``keep_good`` and are ignored in ``scores``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, stage, table
from .words import claim, row_sums, slices

#: Labelled positives that the fit may see.
SAMPLE = 6000
BUCKETS = 256
DENSE = 10
WIDTH = BUCKETS + DENSE
THRESHOLD = 0.7
#: Features are cut at so many deviations from their means; scores at so many units, in so many bins.
CUT, SPAN, BINS = 8.0, 4.0, 4096
#: The ridge on standardised features is so many times features a positive: fewer positives, smoother weights.
RIDGE = 2.0
#: The bucket of each byte pair; pairs that share a bucket share a weight.
PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)


def _counts(t) -> np.ndarray:
    """Rates per text that byte pairs don't show."""
    n = len(t.bounds) - 1
    words = np.diff(t.bounds).astype(float)
    size = np.diff(t.starts).astype(float)
    rows = np.repeat(np.arange(n), np.diff(t.bounds))
    same = np.zeros(len(t.codes))
    if len(t.codes) > 1:
        same[1:] = (t.codes[1:] == t.codes[:-1]) & (rows[1:] == rows[:-1])
    distinct = np.bincount(np.unique(rows * (len(t.vocab) + 1) + t.codes) // (len(t.vocab) + 1), minlength=n).astype(float) if len(t.codes) else np.zeros(n)
    raw = t.raw
    kind = lambda *spans: np.isin(np.arange(256), np.concatenate([np.arange(a, b + 1) for a, b in spans])).astype(np.float32)
    upper, lower, digit = kind((65, 90)), kind((97, 122)), kind((48, 57))
    mark = kind((33, 38), (40, 43), (47, 47), (60, 64), (91, 96), (123, 126))
    sums = [row_sums(k[raw], t.starts) for k in (upper, lower, digit, mark, kind((10, 10)))]
    some, letters, w = np.maximum(size, 1), np.maximum(sums[0] + sums[1], 1), np.maximum(words, 1)
    return np.stack([row_sums(same, t.bounds) / w, distinct / w, np.log1p(words), np.minimum(size / w, 40), sums[0] / letters, sums[2] / some, sums[3] / some, sums[4] / w, np.log1p(sums[3]), (words > 0) * 1.0], axis=1)


def _pairs(t) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte pair and bounds by text; a pair that spans two texts is left out by its bounds."""
    raw = t.raw.astype(np.int64)
    codes = PAIR[(raw[:-1] << 8) | raw[1:]] if len(raw) > 1 else np.empty(0, np.int64)
    return codes, t.starts


def features(column: pa.Array) -> np.ndarray:
    claim("quality", lambda: None)
    out = []
    for t in slices(column):
        codes, starts = _pairs(t)
        dense = _counts(t)
        hashed = np.zeros((len(dense), BUCKETS), dtype=np.float32)
        for i in range(len(dense)):
            a, b = starts[i], max(starts[i], starts[i + 1] - 1)
            if b > a:
                hashed[i] = np.bincount(codes[a:b], minlength=BUCKETS) * (10.0 / (b - a))
        out.append(np.concatenate([hashed, dense], axis=1).astype(np.float16))
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float16)


@dataclass
class Model:
    mean: np.ndarray  # of raw features
    spread: np.ndarray
    weights: np.ndarray  # of standardised features, the bias last
    slope: float
    shift: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.spread) @ self.weights.astype(np.float32)

    def of_features(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.clip(self.raw(x).astype(np.float64), -SPAN, SPAN) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.of_features(features(column))


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, cut, and a column of ones."""
    z = np.clip((x.astype(np.float32) - mean) / spread, -CUT, CUT)
    return np.concatenate([z, np.ones((len(z), 1), np.float32)], axis=1).astype(np.float32)


def negative_risk(w: np.ndarray, prior: float, unl: np.ndarray, pos: np.ndarray) -> float:
    """E_u[(1 + g)^2] - prior * E_p[(1 + g)^2] from second moments (of features and a one, in the last place)."""
    part = lambda m: 1 + 2 * w @ m[-1] + w @ m @ w
    return float(part(unl) - prior * part(pos))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 0.02, steps: int = 400) -> np.ndarray:
    """Weights that minimise the non-negative risk with the squared loss; pos, unl: second moments of either kind.

    Below zero of the second term, only that term is followed, upwards; the best weights on the way stay."""
    keep = np.eye(len(unl)) * ridge
    keep[-1, -1] = 0
    w = np.linalg.solve(unl + keep + 1e-9 * np.eye(len(unl)), 2 * prior * pos[-1] - unl[-1])
    risk = lambda v: prior * (1 - 2 * v @ pos[-1] + v @ pos @ v) + max(0.0, negative_risk(v, prior, unl, pos)) + v @ keep @ v
    if negative_risk(w, prior, unl, pos) >= 0:
        return w
    best, least = w, risk(w)
    rate = 1 / max(np.linalg.norm(unl, 2) + prior * np.linalg.norm(pos, 2), 1e-9)
    for _ in range(steps):
        below = 2 * (unl[-1] + unl @ w - prior * (pos[-1] + pos @ w))
        if negative_risk(w, prior, unl, pos) >= 0:
            move = 2 * prior * (pos @ w - pos[-1]) + below + 2 * keep @ w
        else:
            move = -below
        w = w - rate / 2 * move
        if not np.abs(w).max() < 1e6:  # too few rows to hold it
            break
        if (now := risk(w)) < least:
            best, least = w, now
    return best


def best_bin_prior(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled, from histograms of one score (ascending) of either kind.

    Above a threshold where hardly a negative lies, unlabelled rows are as frequent as positive ones times the
    share; the threshold is that of the least upper confidence bound."""
    q_p, q_u = (np.cumsum(h[::-1])[::-1] / max(1, h.sum()) for h in (pos, unl))
    slack = math.sqrt(math.log(4 / delta) / (2 * max(1, n_unl))) + math.sqrt(math.log(4 / delta) / (2 * max(1, n_pos)))
    ok = q_p > 0
    if not ok.any():
        return 0.5
    bound = np.where(ok, q_u / np.maximum(q_p, 1e-12) + (1 + gamma) / np.maximum(q_p, 1e-12) * slack, np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(q_u[at] / q_p[at], 0.01, 0.99))


def calibrate(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift that minimise the unbiased logistic risk  E_u[log(1 + e^z)] - prior * E_p[z];
    pos: scores of positives, unl: histogram of the unlabelled scores."""
    mid = (np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN
    share = unl / max(1, unl.sum())
    a, b, top = 2.0, 0.0, prior * np.array([pos.mean(), 1.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * mid + b, -40, 40)))
        g = np.array([(share * p * mid).sum(), (share * p).sum()]) - top + ridge * np.array([a - 2.0, b])
        h = share * p * (1 - p)
        hess = np.array([[(h * mid * mid).sum() + ridge, (h * mid).sum()], [(h * mid).sum(), h.sum() + ridge]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-10:
            break
    return (float(a), float(b)) if a > 0 else (2.0, 0.0)


# --- passes over all rows ------------------------------------------------------------------------------------------


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every document: its features as 16-bit numbers."""
    small_batches(docs.sparkSession)

    def each(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")


def opened(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, WIDTH)


def summed(rows: DataFrame, length: int, add) -> np.ndarray:
    """The sum over all batches of x of add(features), an array of some length.

    Tasks add up what they read, and their sums meet in pieces; few values leave the cluster, whatever the input."""
    spark = rows.sparkSession
    pieces = 16

    def each(batches):
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += add(opened(batch.column(0)))
        parts = np.array_split(total, pieces)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "sums"])

    def meet(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "sums"])

    # as many sums as the cluster has cores, a few times over, not as many as there are files
    few = rows.select("x").coalesce(max(1, 4 * spark.sparkContext.defaultParallelism))
    got = few.mapInArrow(each, "piece int, sums binary").repartition(pieces, "piece").mapInArrow(meet, "piece int, sums binary").collect()
    parts = {r["piece"]: np.frombuffer(r["sums"]) for r in got}
    return np.concatenate([parts[i] for i in range(pieces)]) if parts else np.zeros(length)


def second_moments(x: np.ndarray) -> np.ndarray:
    return (x.T @ x).astype(np.float64) / max(1, len(x))


def _histogram(g: np.ndarray) -> np.ndarray:
    at = np.clip(((g + SPAN) * (BINS / (2 * SPAN))).astype(np.int64), 0, BINS - 1)
    return np.bincount(at, minlength=BINS).astype(np.float64)


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from feature rows (doc_id, x) that are not held out; None without a positive label.

    rows are read four times: stage them."""
    spark = rows.sparkSession
    free = rows.where(~held_out(F.col("doc_id")))
    marks = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    by_hash = [F.xxhash64("doc_id", F.lit(17)), "doc_id"]
    chosen = [r[0] for r in free.select("doc_id").distinct().join(marks, "doc_id").orderBy(*by_hash).limit(sample).collect()]  # sample ids at most
    if not chosen:
        return None
    few = spark.createDataFrame([(i,) for i in chosen], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")
    p = free.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")  # 532 bytes each
    raw = opened(p.column("x"))

    sums = summed(free, 2 * WIDTH + 1, lambda x: np.concatenate([x.sum(axis=0, dtype=np.float64), np.square(x, dtype=np.float64).sum(axis=0), [len(x)]]))
    n = int(sums[-1])
    mean = sums[:WIDTH] / n
    spread = np.maximum(np.sqrt(np.maximum(sums[WIDTH:-1] / n - mean**2, 0)), 1e-3).astype(np.float32)
    mean = mean.astype(np.float32)
    size = WIDTH + 1

    def moment(x):
        z = standard(x, mean, spread)
        return (z.T @ z).astype(np.float64).reshape(-1)

    unl = summed(free, size * size, moment).reshape(size, size) / n
    pos = standard(raw, mean, spread)
    fold = np.arange(len(pos)) % 2 if len(pos) > 1 else np.zeros(1, int)
    halves = [pos[fold != k] if (fold != k).any() else pos for k in (0, 1)]

    def unseen(models: list[np.ndarray]) -> np.ndarray:
        """Scores of positives by the model of the other fold."""
        return np.where(fold == 0, pos @ models[0], pos @ models[1]).clip(-SPAN, SPAN)

    def histograms(models: list[np.ndarray]) -> list[np.ndarray]:
        w = np.stack(models, axis=1).astype(np.float32)
        got = summed(free, BINS * len(models), lambda x: np.concatenate([_histogram(g) for g in (standard(x, mean, spread) @ w).T]))
        return list(got.reshape(len(models), BINS))

    learnt = lambda p, share: fit_nnpu(second_moments(p), unl, share, RIDGE * WIDTH / len(p))
    first = [learnt(h, 0.5) for h in halves]
    own = unseen(first)
    seen = histograms(first)
    prior = float(np.mean([best_bin_prior(_histogram(own[fold == k]), seen[k], int((fold == k).sum()), n) for k in (0, 1) if (fold == k).any()]))
    weights = learnt(pos, prior)
    own = unseen([learnt(h, prior) for h in halves])
    slope, shift = calibrate(own, histograms([weights])[0], prior)
    return Model(mean, spread, weights, slope, shift, prior)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    return fit(stage(feature_rows(docs), "features"), labels, sample)


def scores(rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of feature rows."""

    def each(batches):
        claim("quality", lambda: None)
        for batch in batches:
            got = np.ones(batch.num_rows) if model is None else model.of_features(opened(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores threshold or more, all columns kept."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def each(batches):
        for batch in batches:
            if model is None:
                yield batch
            else:
                yield batch.filter(pc.greater_equal(pa.array(model.scores(batch.column(at))), threshold))

    return docs.mapInArrow(each, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(feature_rows(table(spark, sf_dir, "documents")), "features")
    out = scores(rows, fit(rows, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
