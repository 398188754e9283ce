"""Training tables end to end: outer assembly, preparation fitted on the training part, cross features, tuning.

What is fitted is a handful of numbers a column.  It is fitted on one frame and
applied to another, so nothing of a test part reaches its own preparation.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY
from barsmith.operators import period, relative, rolling
from barsmith.plans import features, selection

BASIC = ("log_return", "open", "close", "high", "low", "vol", "amount")


def merge_tables(tables: list[DataFrame], keys: tuple[str, ...] = (KEY, DATE)) -> DataFrame:
    """Full outer join of tables on their keys, however many, in one shuffle: a union, then the one value of
    each column.  Of a column that several tables have, the first table's value counts."""
    names = list(dict.fromkeys(c for t in tables for c in t.columns if c not in keys))
    parts = [t.select(*keys, *(F.struct(F.lit(i).alias("i"), F.col(c).alias("v")).alias(c) for c in t.columns if c not in keys)) for i, t in enumerate(tables)]
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy(*keys).agg(*(F.min(F.when(F.col(f"{c}.v").isNotNull(), F.col(c))).getField("v").alias(c) for c in names))


def assemble(panel: DataFrame, rolling_metrics: Iterable[str] = (), windows: Iterable[int] = (), period_metrics: Iterable[str] = (), periods: Iterable[str] = (), relatives: Iterable[tuple[str, str]] = (), basic: bool = True) -> DataFrame:
    """(ts_code, trade_date, features): rolling metrics of all windows in one plan, period metrics, relative
    metrics of (current, history) pairs and the bars' own columns, joined outer."""
    tables = []
    if basic:
        tables.append(panel.select(KEY, DATE, *(c for c in BASIC if c in panel.columns)))
    if rolling_metrics and windows:
        tables.append(rolling.wide(panel, rolling_metrics, windows))
    names, periods = [m.replace("-", "_") for m in period_metrics], list(periods)
    if names and periods:  # one pass over each code for all periods; a row a period then becomes columns
        long = period.period_catalogue(panel, periods, names)
        one = [F.max(F.when(F.col("period") == p, F.col(m))).alias(f"{m}_{p}") for p in periods for m in names]
        tables.append(long.groupBy(KEY, F.col(period.END).alias(DATE)).agg(*one))
    for current, history in relatives:
        wide = relative.relative_metrics(panel, current, history)
        tables.append(wide.select(KEY, DATE, *(F.col(c).alias(f"{c}_{current}") for c in wide.columns if c not in (KEY, DATE))))
    return merge_tables(tables)


@dataclass
class Preparation:
    """Numbers of a training frame: by column (fill, lo, hi, mean, deviation)."""

    columns: list[str]
    stats: dict[str, tuple]
    fill: str
    how: str

    def apply(self, df: DataFrame) -> DataFrame:
        """df with its columns filled and scaled by what was fitted; with fill "drop" rows with a gap go."""
        if self.fill == "drop":
            df = df.dropna(subset=self.columns)
        out = []
        for c in df.columns:
            if c not in self.stats:
                out.append(F.col(c))
                continue
            fill, lo, hi, mean, dev = self.stats[c]
            x = F.col(c) if self.fill == "drop" else F.coalesce(F.col(c), F.lit(fill))
            out.append(_scaled(x, lo, hi, mean, dev, self.how).alias(c))
        return df.select(*out)


def _scaled(x, lo, hi, mean, dev, how: str):
    if how == "none" or lo is None:
        return x
    if how == "standard":  # a constant column only loses its mean
        return (x - mean) / (dev or 1.0)
    if how == "both":
        how = "minmax" if lo >= 0 else "negative" if hi <= 0 else "zscore"
    if how == "zscore":
        return F.when(F.lit(bool(dev)), (x - mean) / F.lit(dev or 1.0))
    if hi == lo:
        return F.lit(None).cast("double")
    return (x - lo) / (hi - lo) if how == "minmax" else (F.lit(hi) - x) / (hi - lo)


def fit(train: DataFrame, columns: list[str], fill: str = "median", how: str = "both") -> Preparation:
    """Fill by a column's "median" or "mean" or not ("drop"), scale by "both", "minmax", "zscore", "standard" or "none"."""
    rows = train.dropna(subset=columns) if fill == "drop" else train
    value = {"median": lambda c: F.expr(f"percentile(`{c}`, 0.5)"), "mean": F.avg, "drop": F.avg}[fill]
    fills = rows.agg(*(value(c).cast("double").alias(c) for c in columns)).first()  # a number a column
    filled = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in columns))
    got = filled.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("dev", F.stddev_pop)))).first()
    return Preparation(columns, {c: (fills[c], *(got[f"{n}_{c}"] for n in ("lo", "hi", "mean", "dev"))) for c in columns}, fill, how)


def prepare(rows: DataFrame, columns: list[str], days: int = 20, threshold: float = 0.0, train_end: str = "2023-12-31", test_start: str = "2024-01-01", test_end: str = "2025-03-31", train_start: str | None = None, fill: str = "drop", how: str = "both") -> tuple[DataFrame, DataFrame]:
    """Labelled training and test parts: forward returns, labels of two classes (three with a threshold), the
    split by date, and columns prepared by what the training part holds.  rows hold close and the columns."""
    labelled = rows.withColumn("forward", F.expr(features.future_log_return(days)))
    labelled = labelled.withColumn("label", F.expr(features.label("forward", threshold, 3 if threshold else 2)))
    train, test = features.split(labelled, train_end, test_start, test_end, train_start)
    fitted = fit(train, columns, fill, how)
    return fitted.apply(train), fitted.apply(test)


def prepare_sequence(rows: DataFrame, columns: list[str], share: float = 0.8, price: str = "close") -> tuple[DataFrame, DataFrame]:
    """Training and test parts of each code in time: from the day on which all columns are known, gaps filled
    forward only, rows that still have one dropped, the first share of rows for training; columns standardised
    by the training rows, the price left as it is."""
    known = [*columns, price]
    rows = rows.select(KEY, DATE, *(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in dict.fromkeys(known)))
    code, along = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy(DATE)
    begun = F.greatest(*(F.min(F.when(F.col(c).isNotNull(), F.col(DATE))).over(code) for c in dict.fromkeys(known))) if len(set(known)) > 1 else F.min(F.when(F.col(price).isNotNull(), F.col(DATE))).over(code)
    rows = rows.withColumn("_begun", begun).where(F.col(DATE) >= F.col("_begun")).drop("_begun")
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(along) for c in dict.fromkeys(known)}).dropna(subset=known)
    rows = rows.withColumn("_k", F.row_number().over(along)).withColumn("_n", F.floor(F.count("*").over(code) * share))
    train, test = rows.where("_k <= _n").drop("_k", "_n"), rows.where("_k > _n").drop("_k", "_n")
    fitted = fit(train, [c for c in columns if c != price], "drop", "standard")
    return fitted.apply(train), fitted.apply(test)


# --- cross features ----------------------------------------------------------------------------------------------

_ONE = {"square": "{x} * {x}", "root": "sqrt(abs({x}))", "log": "CASE WHEN {x} <> 0 THEN ln(abs({x})) END", "inverse": "1 / nullif({x}, 0)"}
_TWO = {"product": "{x} * {y}", "ratio": "{x} / nullif({y}, 0)", "sum": "{x} + {y}", "difference": "{x} - {y}"}


def cross_candidates(columns: list[str], steps: int = 2) -> dict[str, str]:
    """Name -> expression: transforms of single columns, and with two steps combinations of two columns."""
    out = {f"{k}_{c}": e.format(x=f"`{c}`") for c in columns for k, e in _ONE.items()}
    if steps > 1:
        out |= {f"{k}_{a}_{b}": e.format(x=f"`{a}`", y=f"`{b}`") for i, a in enumerate(columns) for b in columns[i + 1 :] for k, e in _TWO.items()}
    return out


_ONE_OF = {"square": lambda x: x * x, "root": lambda x: np.sqrt(np.abs(x)), "log": lambda x: np.where(x != 0, np.log(np.abs(x)), np.nan), "inverse": lambda x: np.where(x != 0, 1 / x, np.nan)}
_TWO_OF = {"product": lambda x, y: x * y, "ratio": lambda x, y: np.where(y != 0, x / y, np.nan), "sum": lambda x, y: x + y, "difference": lambda x, y: x - y}


def cross_arrays(columns: list[str], steps: int = 2) -> selection.Candidates:
    """The candidates of cross_candidates, in its order, as functions of the columns' values."""
    made = {f"{k}_{c}": lambda x, f=f, i=i: f(x[i]) for i, c in enumerate(columns) for k, f in _ONE_OF.items()}
    if steps > 1:
        made |= {f"{k}_{a}_{b}": lambda x, f=f, i=i, j=j: f(x[i], x[j]) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j for k, f in _TWO_OF.items()}
    return selection.Candidates(columns, made)


def cross_features(train: DataFrame, columns: list[str], target: str, top: int = 10, steps: int = 2) -> dict[str, str]:
    """The candidates that a lasso of the target keeps on the training rows, at most so many, largest coefficient first.

    They are chosen together: of candidates that say the same, one stays."""
    made = cross_candidates(columns, steps)
    rows = train.select(*(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*columns, target]))).persist()
    try:
        chosen, _ = selection.lasso_path(rows, cross_arrays(columns, steps), target, top)
    finally:
        rows.unpersist()
    return {n: made[n] for n in chosen}


def with_cross_features(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *(f"{e} AS `{n}`" for n, e in chosen.items()))


# --- models ------------------------------------------------------------------------------------------------------

#: Ranges of the parameters that a search may draw, low and high (integers below high, numbers below high).
SEARCH_SPACES = {
    "RandomForestClassifier": {"numTrees": (100, 1000), "maxDepth": (5, 20), "minInstancesPerNode": (1, 5)},
    "GBTClassifier": {"maxIter": (100, 1000), "stepSize": (0.01, 0.31), "maxDepth": (3, 10), "minInstancesPerNode": (1, 5), "subsamplingRate": (0.6, 1.0)},
    "LogisticRegression": {"regParam": (0.0, 1.0), "elasticNetParam": (0.0, 1.0)},
    "LinearSVC": {"regParam": (0.0, 1.0)},
}


def draw_parameters(model: str, n: int, seed: int = 42, limits: dict[str, tuple] | None = None) -> list[dict]:
    """n random settings of a model; limits narrow or replace ranges."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        one = {}
        for name, (lo, hi) in (SEARCH_SPACES[model] | (limits or {})).items():
            one[name] = int(rng.integers(lo, hi)) if isinstance(lo, int) and isinstance(hi, int) else float(rng.uniform(lo, hi))
        out.append(one)
    return out


def time_folds(df: DataFrame, folds: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) pairs that grow in time: each validates on the block of dates after its training dates."""
    days = df.select(DATE).distinct().withColumn("_block", F.ntile(folds + 1).over(Window.orderBy(DATE)))  # a row a trading date
    rows = df.join(F.broadcast(days), DATE)
    return [(rows.where(f"_block <= {k}").drop("_block"), rows.where(f"_block = {k + 1}").drop("_block")) for k in range(1, folds + 1)]


def f1(scored: DataFrame, target: str, classes: int = 2) -> float:
    """F1 of class 1, or with more classes the mean over them."""
    counts = {(r["y"], r["p"]): r["n"] for r in scored.groupBy(F.col(target).cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    values = []
    for c in [1] if classes == 2 else range(classes):
        hit = counts.get((c, c), 0)
        said, true = sum(n for (_, p), n in counts.items() if p == c), sum(n for (y, _), n in counts.items() if y == c)
        values.append(2 * hit / (said + true) if said + true else 0.0)
    return sum(values) / len(values)


def tune(train: DataFrame, columns: list[str], target: str = "label", model: str = "RandomForestClassifier", n_iter: int = 20, folds: int = 5, seed: int = 42, classes: int = 2, limits: dict[str, tuple] | None = None) -> tuple[dict, float]:
    """The best of n_iter random settings by mean F1 over folds in time, and that F1."""
    import pyspark.ml.classification as kinds
    from pyspark.ml.feature import VectorAssembler

    to = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip")
    pairs = [(to.transform(a).select("_v", target).cache(), to.transform(b).select("_v", target).cache()) for a, b in time_folds(train, folds)]
    best, top = {}, -math.inf
    for setting in draw_parameters(model, n_iter, seed, limits):
        made = getattr(kinds, model)(featuresCol="_v", labelCol=target, **setting, **({"seed": seed} if hasattr(getattr(kinds, model), "seed") else {}))
        score = float(np.mean([f1(made.fit(a).transform(b), target, classes) for a, b in pairs]))
        if score > top:
            best, top = setting, score
    for a, b in pairs:
        a.unpersist()
        b.unpersist()
    return best, top


def boost(train: DataFrame, test: DataFrame, columns: list[str], target: str = "label", setting: dict | None = None, seed: int = 42) -> DataFrame:
    """test with the boosted trees' score and the prediction at the threshold that is best by F1 on the last fold in time."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    to = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip")
    score = vector_to_array("probability")[1].alias("score")
    build = lambda: GBTClassifier(featuresCol="_v", labelCol=target, seed=seed, **(setting or {"maxIter": 20}))
    early, late = time_folds(train, 4)[-1]
    held = build().fit(to.transform(early)).transform(to.transform(late)).select(target, score)
    cut = features.optimal_threshold(held, target, "score").first()
    at = cut["threshold"] if cut and cut["threshold"] is not None else 0.5
    out = build().fit(to.transform(train)).transform(to.transform(test))
    return out.withColumn("score", score).withColumn("prediction", (F.col("score") >= at).cast("int")).drop("_v", "rawPrediction", "probability")
