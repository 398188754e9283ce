"""Joint selection of features: a lasso over many candidates, and trees with random cuts.

Candidates are worked out from the base columns a batch of rows and a block of
candidates at a time and are never stored.  The lasso keeps the Gram matrix of its
working set alone: a pass sums the products of all candidates with the residual and
of the working set with itself, coordinate descent runs on those sums, and
candidates that break the optimality conditions join the set.  Trees grow level by
level; a pass sums what all open nodes of all trees need.  Only sums, a few numbers a
candidate or node, leave the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates that a task works out at once.
BLOCK = 256


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """A row a column; what is not a finite number is NaN."""
    x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns])
    return np.where(np.isfinite(x), x, np.nan)


class Candidates:
    """Named functions of base columns: name -> f(matrix with a row a base column)."""

    def __init__(self, columns: list[str], made: dict[str, Callable[[np.ndarray], np.ndarray]]):
        self.columns, self.names, self.functions = columns, list(made), list(made.values())

    def block(self, base: np.ndarray, which) -> np.ndarray:
        with np.errstate(all="ignore"):
            x = np.stack([self.functions[i](base) for i in which]) if len(which) else np.zeros((0, base.shape[1]))
        return np.where(np.isfinite(x), x, np.nan)


def _sums(rows: DataFrame, columns: list[str], f, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all rows of what f(base matrix of a batch) gives: {(i, j): width numbers}, added up in each task first."""

    def each(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for key, v in f(_matrix(b, columns)):
                    total[key] = total[key] + v if key in total else v
        if total:
            keys = np.array(list(total), np.int64)
            values = np.stack(list(total.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(pa.array(values[:, k]) for k in range(width))], ["i", "j", *(f"s{k}" for k in range(width))])

    made = rows.select(*columns).mapInArrow(each, "i long, j long, " + ", ".join(f"s{k} double" for k in range(width)))
    got = made.groupBy("i", "j").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(width))).collect()
    return {(r["i"], r["j"]): np.array(r[2:], float) for r in got}


def coordinate_descent(gram: np.ndarray, goal: np.ndarray, penalty: float, start: np.ndarray, tolerance: float = 1e-12, sweeps: int = 20_000) -> np.ndarray:
    """The minimum of b'Gb / 2 - c'b + penalty * |b|."""
    b = start.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            if gram[j, j] > 0:
                pull = goal[j] - gram[j] @ b + gram[j, j] * b[j]
                new = np.sign(pull) * max(abs(pull) - penalty, 0) / gram[j, j]
                most, b[j] = max(most, abs(new - b[j])), new
        if most < tolerance:
            break
    return b


def lasso_path(rows: DataFrame, candidates: Candidates, target: str, top: int, ratio: float = 0.7, least: float = 1e-3) -> tuple[dict[str, float], float]:
    """({name: coefficient}, penalty): the lasso of standardised candidates, its penalty lowered by a ratio at a time
    until so many candidates take part, or it is but a share of the first one.

    Missing values of a candidate stand at its mean; rows without a target do not count.  A candidate that is
    constant takes no part.  Of the working set only sums are known to the driver: its size squared."""
    columns = list(dict.fromkeys([*candidates.columns, target]))
    own = [columns.index(c) for c in candidates.columns]
    goal, count = columns.index(target), len(candidates.names)
    rows = rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(*columns)
    blocks = [range(i, min(i + BLOCK, count)) for i in range(0, count, BLOCK)]

    def moments(x):
        y = x[goal]
        yield (-1, 0), np.array([len(y), y.sum(), (y * y).sum()])
        for block in blocks:
            z = candidates.block(x[own], block)
            known = ~np.isnan(z)
            z = np.where(known, z, 0)
            for i, *v in zip(block, known.sum(axis=1), z.sum(axis=1), (z * z).sum(axis=1)):
                yield (i, 0), np.array(v, float)

    first = _sums(rows, columns, moments, 3)
    n, sy, syy = first.get((-1, 0), np.zeros(3))
    if n < 2:
        return {}, 0.0
    known, total, squares = np.stack([first[i, 0] for i in range(count)]).T if count else np.zeros((3, 0))
    mean = total / np.maximum(known, 1)
    spread = np.sqrt(np.maximum(squares - known * mean * mean, 0) / n)  # missing values stand at the mean
    sound = spread > 1e-12 * np.maximum(np.abs(mean), 1e-300)
    centre, width = sy / n, np.sqrt(max(syy / n - (sy / n) ** 2, 0))
    if not sound.any() or not width > 0:
        return {}, 0.0

    def standard(x, which):
        which = np.asarray(which)
        z = (candidates.block(x[own], which) - mean[which][:, None]) / np.where(sound, spread, 1)[which][:, None]
        return np.where(np.isnan(z) | ~sound[which][:, None], 0, z)

    def products(held: list[int], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean products of all candidates with the residual, and of the working set with itself."""

        def f(x):
            z = standard(x, held) if held else np.zeros((0, x.shape[1]))
            rest = (x[goal] - centre) / width - beta @ z
            for block in blocks:
                for i, v in zip(block, standard(x, block) @ rest):
                    yield (i, -1), np.array([v])
            for a, row in enumerate(z @ z.T):
                for b, v in enumerate(row):
                    yield (a, b), np.array([v])

        got = _sums(rows, columns, f, 1)
        return np.array([got[i, -1][0] for i in range(count)]) / n, np.array([[got[a, b][0] for b in range(len(held))] for a in range(len(held))]).reshape(len(held), len(held)) / n

    held: list[int] = []
    beta = np.zeros(0)
    pull, gram = products(held, beta)
    goals = pull.copy()  # with the target itself
    penalty = before = float(np.abs(pull[sound]).max())
    stop = penalty * least
    while penalty > stop and (beta != 0).sum() < top:
        before, penalty = penalty, max(penalty * ratio, stop)
        # candidates that could come in by the sequential rule; what it misses is found by the conditions below
        fresh = [i for i in np.flatnonzero(sound & (np.abs(pull) >= 2 * penalty - before)) if i not in held]
        while True:
            if fresh:
                held, beta = held + [int(i) for i in fresh], np.concatenate([beta, np.zeros(len(fresh))])
                _, gram = products(held, beta)
            beta = coordinate_descent(gram, goals[held], penalty, beta)
            pull, gram = products(held, beta)
            fresh = [i for i in np.flatnonzero(sound & (np.abs(pull) > penalty * (1 + 1e-9))) if i not in held]
            if not fresh:
                break
    order = sorted((i for i in range(len(held)) if beta[i]), key=lambda i: (-abs(beta[i]), candidates.names[held[i]]))
    return {candidates.names[held[i]]: float(beta[i]) for i in order[:top]}, penalty


# --- extremely randomised trees ----------------------------------------------------------------------------------


class Tree:
    """Nodes by number (children of k are 2k + 1 and 2k + 2): inner ones hold (column, cut)."""

    def __init__(self) -> None:
        self.cuts: dict[int, tuple[int, float]] = {}

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row (columns of x) has come to after so many levels."""
        at = np.zeros(x.shape[1], np.int64)
        for _ in range(depth):
            for node in np.unique(at):
                if node in self.cuts:
                    column, cut = self.cuts[node]
                    own = at == node
                    at[own] = 2 * node + np.where(x[column, own] < cut, 1, 2)
        return at


def draw_columns(seed: int, tree: int, node: int, n: int, many: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node]).permutation(n)[:many]


def draw_cut(seed: int, tree: int, node: int, column: int, low: float, high: float) -> float:
    return float(np.random.default_rng([seed, tree, node, column, 1]).uniform(low, high))


def impurity(counts: np.ndarray) -> float:
    """Gini impurity times the number of rows."""
    n = counts.sum()
    return float(n - (counts * counts).sum() / n) if n else 0.0


def extra_trees(rows: DataFrame, columns: list[str], target: str = "label", trees: int = 20, depth: int = 6, least: int = 2, seed: int = 42, classes: int = 2) -> tuple[list[Tree], np.ndarray]:
    """(trees, importance of each column): every open node draws some columns and for each one cut at random between its
    rows' extremes, and takes the cut that lowers the Gini impurity most.

    All rows grow all trees.  A level is two passes: extremes, then class counts left of the cuts; each sums in the
    tasks first, so what leaves them is some numbers a node.  Rows with a missing value do not count."""
    names = list(dict.fromkeys([*columns, target]))
    goal, own = names.index(target), [names.index(c) for c in columns]
    rows = rows.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    many = max(1, round(len(columns) ** 0.5))
    forest, gains = [Tree() for _ in range(trees)], np.zeros(len(columns))
    open_ = [(t, 0) for t in range(trees)]
    for level in range(depth):
        drawn = {(t, node): draw_columns(seed, t, node, len(columns), many) for t, node in open_}
        at = {key: i for i, key in enumerate(open_)}

        def members(x):
            for t in sorted({t for t, _ in open_}):
                leaf = forest[t].leaves(x, level)
                for node in np.unique(leaf):
                    if (t, node) in at:
                        yield at[t, int(node)], drawn[t, int(node)], leaf == node

        def extremes(x):
            x, y = x[own], x[goal]
            for i, chosen, inside in members(x):
                for c in chosen:
                    yield (i, c), x[c, inside]

        # extremes do not add up, so they have a pass of their own kind
        bounds = _extremes(rows, names, extremes)
        cuts = {(i, c): draw_cut(seed, *open_[i], c, lo, hi) for (i, c), (lo, hi) in bounds.items() if lo < hi}

        def counts(x):
            x, y = x[own], x[goal].astype(np.int64)
            for i, chosen, inside in members(x):
                yield (i, -1), np.bincount(y[inside], minlength=classes)[:classes].astype(float)
                for c in chosen:
                    if (i, c) in cuts:
                        yield (i, c), np.bincount(y[inside & (x[c] < cuts[i, c])], minlength=classes)[:classes].astype(float)

        got = _sums(rows, names, counts, classes)
        nodes, open_ = open_, []
        for i, (t, node) in enumerate(nodes):
            whole = got.get((i, -1))
            if whole is None or whole.sum() < 2 * least or impurity(whole) == 0:
                continue
            best = (0.0, -1)
            for c in sorted(int(c) for c in drawn[t, node]):
                left = got.get((i, c))
                if left is not None and min(left.sum(), whole.sum() - left.sum()) >= least:
                    best = max(best, (impurity(whole) - impurity(left) - impurity(whole - left), c), key=lambda v: v[0])
            if best[1] >= 0 and best[0] > 1e-12:
                forest[t].cuts[node] = best[1], cuts[i, best[1]]
                gains[best[1]] += best[0]
                open_ += [(t, 2 * node + 1), (t, 2 * node + 2)]
        if not open_:
            break
    return forest, gains / gains.sum() if gains.sum() else gains


def _extremes(rows: DataFrame, columns: list[str], f) -> dict[tuple[int, int], tuple[float, float]]:
    def each(batches):
        found: dict[tuple[int, int], tuple[float, float]] = {}
        for b in batches:
            if b.num_rows:
                for key, v in f(_matrix(b, columns)):
                    lo, hi = found.get(key, (np.inf, -np.inf))
                    found[key] = min(lo, float(v.min())), max(hi, float(v.max()))
        if found:
            keys, values = np.array(list(found), np.int64), np.array(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(values[:, 0]), pa.array(values[:, 1])], ["i", "j", "lo", "hi"])

    made = rows.select(*columns).mapInArrow(each, "i long, j long, lo double, hi double")
    return {(r["i"], r["j"]): (r["lo"], r["hi"]) for r in made.groupBy("i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
