"""The lasso and the randomised trees against plain NumPy on the same rows."""

import math

import numpy as np
import pytest

from barsmith.plans import modelling, selection


def frame(spark, x, y, names):
    rows = [tuple(None if v != v else float(v) for v in [*r, t]) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "t"])).repartition(3)


def plain_lasso(z, y, penalty, sweeps=20000):
    """Cyclic descent on the rows themselves."""
    n, b = len(y), np.zeros(z.shape[1])
    rest = y.copy()
    for _ in range(sweeps):
        before = b.copy()
        for j in range(z.shape[1]):
            size = z[:, j] @ z[:, j] / n
            if size:
                pull = z[:, j] @ rest / n + size * b[j]
                new = math.copysign(max(abs(pull) - penalty, 0), pull) / size
                rest += z[:, j] * (b[j] - new)
                b[j] = new
        if np.abs(b - before).max() < 1e-13:
            break
    return b


@pytest.mark.parametrize("block", [3, 256])
def test_lasso_equals_numpy(spark, block, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 3, 0.1, 2] + [0, 5, 0, -1]
    x[rng.random(x.shape) < 0.05] = np.nan
    clean = np.where(np.isnan(x), 0, x)
    y = clean[:, 0] * clean[:, 1] - 2 * clean[:, 3] + rng.normal(size=300)
    y[7] = np.nan
    names = list("abcd")
    made = modelling.cross_arrays(names)
    assert made.names == list(modelling.cross_candidates(names))
    got, penalty = selection.lasso_path(frame(spark, x, y, names), made, "t", 6)
    x, y = x[~np.isnan(y)], y[~np.isnan(y)]
    with np.errstate(all="ignore"):
        z = made.block(x.T, range(len(made.names))).T
    z = z - np.nanmean(z, axis=0)
    z = np.where(np.isnan(z), 0, z)
    z /= np.sqrt((z * z).mean(axis=0))
    y = (y - y.mean()) / y.std()
    want = dict(zip(made.names, plain_lasso(z, y, penalty)))
    kept = {n: v for n, v in want.items() if abs(v) > 1e-9}
    assert len(kept) >= 6 and list(got) == sorted(kept, key=lambda n: (-abs(kept[n]), n))[:6]
    assert all(abs(want[n] - v) < 1e-7 for n, v in got.items())
    assert max(abs(z.T @ (y - z @ np.array(list(want.values())))) / len(y)) <= penalty * (1 + 1e-6)


def test_twins_are_not_all_kept(spark):
    """Squares and products of equal columns say the same: a ranking by correlation would keep them all."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = frame(spark, np.stack([a, a * (1 + 1e-3 * rng.normal(size=400)), b], axis=1), a * a + 0.3 * b, ("a", "twin", "b"))
    chosen = modelling.cross_features(df, ["a", "twin", "b"], "t", 3)
    same = {"square_a", "square_twin", "product_a_twin"}
    assert len(same & set(chosen)) <= 2 and next(iter(chosen)) in same and any("b" in n for n in set(chosen) - same)


def test_lasso_odd_tables(spark):
    made = modelling.cross_arrays(["a"])
    for rows in ([], [(1.0, 1.0)], [(1.0, None), (2.0, None)], [(1.0, 3.0), (1.0, 4.0)], [(1.0, 3.0), (2.0, 3.0)], [(None, 1.0), (float("nan"), 2.0)]):
        assert selection.lasso_path(spark.createDataFrame(rows, "a double, t double"), made, "t", 3)[0] == {}


def plain_trees(x, y, trees, depth, least, seed):
    """Node by node on all rows, with the draws of the engine."""
    gains, many = np.zeros(x.shape[1]), max(1, round(x.shape[1] ** 0.5))

    def gini(v):
        return len(v) * (1 - sum((np.mean(v == c)) ** 2 for c in set(v))) if len(v) else 0.0

    def grow(t, node, rows, level):
        if level == depth or len(rows) < 2 * least or gini(y[rows]) < 1e-12:
            return
        best = (0.0, None)
        for c in sorted(selection.draw_columns(seed, t, node, x.shape[1], many).tolist()):
            lo, hi = x[rows, c].min(), x[rows, c].max()
            if lo < hi:
                cut = selection.draw_cut(seed, t, node, c, lo, hi)
                left, right = rows[x[rows, c] < cut], rows[x[rows, c] >= cut]
                gain = gini(y[rows]) - gini(y[left]) - gini(y[right])
                if min(len(left), len(right)) >= least and gain > best[0]:
                    best = (gain, (c, left, right))
        if best[1] is not None and best[0] > 1e-12:
            c, left, right = best[1]
            gains[c] += best[0]
            grow(t, 2 * node + 1, left, level + 1)
            grow(t, 2 * node + 2, right, level + 1)

    for t in range(trees):
        grow(t, 0, np.arange(len(y)), 0)
    return gains / gains.sum()


def test_trees_equal_plain_python(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(250, 5)), 2)
    y = ((x[:, 1] + 0.5 * x[:, 3] + 0.2 * rng.normal(size=250)) > 0).astype(int)
    forest, got = selection.extra_trees(frame(spark, x, y, "abcde"), list("abcde"), "t", trees=7, depth=4, seed=5)
    want = plain_trees(x, y, 7, 4, 2, 5)
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert got.argmax() == 1 and sum(len(t.cuts) for t in forest) > 20
    none = selection.extra_trees(frame(spark, x[:0], y[:0], "abcde"), list("abcde"), "t")
    assert not none[1].any() and all(not t.cuts for t in none[0])
