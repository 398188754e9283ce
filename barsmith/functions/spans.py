"""Numbers of many spans of one series at once, each from a few look-ups whatever the spans' lengths.

A span is a range [lo, hi) of rows; lo and hi are arrays, one entry a span.  Sums
and moments come from prefix sums in extended precision, minima and maxima from
tables of doubling ranges, order statistics from a tree that splits ranks bit by
bit, drawdowns from jumps along the chain of ever higher values.  Building takes
n log n steps for n rows, a span at most log n; none of it depends on how many
rows a span holds.  Missing values are NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np


def prefix(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    out = np.zeros(len(x) + 1, np.longdouble if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=out[1:])
    return out


def significant_digits(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Numbers rounded for comparison, as ``staged.significant`` says it in SQL."""
    with np.errstate(all="ignore"):
        size = np.ceil(np.log10(np.abs(x)))
        up, down = np.power(10.0, digits - np.maximum(size, 0)), np.power(10.0, size - digits)
        out = np.where(size > digits, np.floor(x / down + 0.500001) * down, np.floor(x * up + 0.500001) / up)
        out = np.where(np.abs(x) >= 1e15, np.sign(x) * (1e15 + np.floor(np.log10(np.abs(x)) * 1e6 + 0.5)), out)
        return np.where(x == 0, 0.0, out)


class Extremes:
    """Smallest value of a span and the last place that holds it."""

    def __init__(self, x: np.ndarray):
        values, places = [np.where(np.isnan(x), np.inf, x)], [np.arange(len(x))]
        size = 1
        while 2 * size <= len(x):
            a, b = values[-1][:-size], values[-1][size:]
            later = b <= a
            values.append(np.where(later, b, a))
            places.append(np.where(later, places[-1][size:], places[-1][:-size]))
            size *= 2
        self.starts = np.cumsum([0] + [len(v) for v in values[:-1]])
        self.values, self.places = np.concatenate(values), np.concatenate(places)

    def at(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, place) of each span; spans hold a row at least."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        left = self.starts[level] + lo
        right = self.starts[level] + hi - (1 << level.astype(np.int64))
        pick = np.where(self.values[right] <= self.values[left], right, left)
        return self.values[pick], self.places[pick]


class Ranks:
    """Order statistics of spans of a series without gaps: one level of the tree for each bit of a rank.

    ``steps`` counts the levels that queries have passed through."""

    def __init__(self, x: np.ndarray):
        self.n, self.bits, self.steps = len(x), max(1, len(x).bit_length()), 0
        order = np.argsort(x, kind="stable")
        self.sorted = x[order]
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        self.zeros, self.sums = [], []
        for bit in range(self.bits - 1, -1, -1):
            high = ((rank >> bit) & 1).astype(bool)
            self.zeros.append(prefix((~high).astype(np.int64)))
            rank = np.concatenate([rank[~high], rank[high]])
            self.sums.append(rank)
        self.sums = [prefix(self.sorted[r]) for r in self.sums]

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each span that has so many."""
        lo, hi, k = (np.array(v, np.int64) for v in np.broadcast_arrays(lo, hi, k))
        rank = np.zeros(k.shape, np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[lo], zeros[hi]
            up = k >= b - a
            k, rank = np.where(up, k - (b - a), k), rank | np.where(up, 1 << (self.bits - 1 - level), 0)
            lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
            self.steps += 1
        return self.sorted[np.minimum(rank, self.n - 1)] if self.n else np.full(k.shape, np.nan)

    def up_to(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of each span's values that are not above a value (below it, if strict)."""
        limit = np.searchsorted(self.sorted, value, side="left" if strict else "right")
        count, total = np.zeros(len(limit), np.int64), np.zeros(len(limit), np.longdouble)
        for level, (zeros, sums) in enumerate(zip(self.zeros, self.sums)):
            a, b = zeros[lo], zeros[hi]
            up = ((limit >> (self.bits - 1 - level)) & 1).astype(bool)
            count += np.where(up, b - a, 0)
            total += np.where(up, sums[b] - sums[a], 0)
            lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
            self.steps += 1
        return count, total

    def quantiles(self, lo: np.ndarray, hi: np.ndarray, shares: Sequence[float]) -> list[np.ndarray]:
        """Percentiles with linear interpolation; NaN for empty spans."""
        n = hi - lo
        at = np.array(shares)[None, :] * np.maximum(n - 1, 0)[:, None]
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, np.maximum(n - 1, 0)[:, None])
        a, b = (self.kth(lo[:, None], hi[:, None], k) for k in (low, high))
        out = np.where((n > 0)[:, None], a + (b - a) * (at - low), np.nan)
        return list(out.T)


class Series:
    """A series with gaps.  Spans are ranges of its rows; what is missing does not count."""

    def __init__(self, x: np.ndarray):
        self.x, self.known = x, ~np.isnan(x)
        self.values = x[self.known]
        self.count = prefix(self.known.astype(np.int64))
        self.centre = float(self.values.mean()) if len(self.values) else 0.0

    def inner(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same spans as ranges of the known values."""
        return self.count[lo], self.count[hi]

    @cached_property
    def powers(self) -> list[np.ndarray]:
        off = self.values - self.centre
        return [prefix(off**k) for k in (1, 2, 3, 4)]

    @cached_property
    def changes(self) -> np.ndarray:
        return prefix(np.concatenate([[0], (self.values[1:] != self.values[:-1]).astype(np.int64)]) if len(self.values) else np.zeros(0, np.int64))

    @cached_property
    def ranks(self) -> Ranks:
        return Ranks(self.values)

    @cached_property
    def least(self) -> Extremes:
        return Extremes(self.values)

    @cached_property
    def most(self) -> Extremes:
        return Extremes(-self.values)

    def n(self, lo, hi) -> np.ndarray:
        return self.count[hi] - self.count[lo]

    def constant(self, lo, hi) -> np.ndarray:
        """Whether a span's known values are all the same."""
        a, b = self.inner(lo, hi)
        return self.changes[b] - self.changes[np.minimum(a + 1, b)] == 0

    def total(self, lo, hi) -> np.ndarray:
        a, b = self.inner(lo, hi)
        return (self.powers[0][b] - self.powers[0][a] + (b - a) * np.longdouble(self.centre)).astype(float)

    def mean(self, lo, hi) -> np.ndarray:
        n = self.n(lo, hi)
        return np.where(n > 0, self.total(lo, hi) / np.maximum(n, 1), np.nan)

    def central(self, lo, hi, most: int = 2) -> list[np.ndarray]:
        """Sums of the 2nd to 4th powers of deviations from a span's mean, exactly 0 where all values are the same."""
        a, b = self.inner(lo, hi)
        n = np.maximum(b - a, 1)
        s = [p[b] - p[a] for p in self.powers[:most]]
        m = s[0] / n
        out = [s[1] - n * m * m]
        if most > 2:
            out.append(s[2] - 3 * m * s[1] + 2 * n * m**3)
        if most > 3:
            out.append(s[3] - 4 * m * s[2] + 6 * m * m * s[1] - 3 * n * m**4)
        same = self.constant(lo, hi)
        return [np.where(same, 0, v if k % 2 else np.maximum(v, 0)).astype(float) for k, v in enumerate(out)]

    def deviation(self, lo, hi, ddof: int) -> np.ndarray:
        n = self.n(lo, hi)
        return np.where(n > ddof, np.sqrt(self.central(lo, hi)[0] / np.maximum(n - ddof, 1)), np.nan)

    def minimum(self, lo, hi) -> np.ndarray:
        return self._extreme(self.least, lo, hi)

    def maximum(self, lo, hi) -> np.ndarray:
        return -self._extreme(self.most, lo, hi)

    def _extreme(self, table: Extremes, lo, hi) -> np.ndarray:
        a, b = self.inner(lo, hi)
        out, some = np.full(len(a), np.nan), b > a
        if some.any():
            out[some] = table.at(a[some], b[some])[0]
        return out

    def spread(self, lo, hi, mean) -> np.ndarray:
        """Mean absolute deviation from a span's mean."""
        a, b = self.inner(lo, hi)
        n = b - a
        count, below = self.ranks.up_to(a, b, np.where(n > 0, mean, 0))
        m = np.where(n > 0, mean, 0).astype(np.longdouble)
        total = self.powers[0][b] - self.powers[0][a] + n * np.longdouble(self.centre)
        off = np.maximum(total - 2 * below - (n - 2 * count) * m, 0).astype(float)
        return np.where(n > 0, np.where(self.constant(lo, hi), 0, off) / np.maximum(n, 1), np.nan)

    def quantiles(self, lo, hi, shares: Sequence[float]) -> list[np.ndarray]:
        return self.ranks.quantiles(*self.inner(lo, hi), shares)

    @cached_property
    def _line(self) -> list[np.ndarray]:
        i = np.flatnonzero(self.known).astype(float) - len(self.x) // 2
        return [prefix(v) for v in (i, i * i, i * (self.values - self.centre))]

    def regression(self, lo, hi) -> list[np.ndarray]:
        """Sums of squares and products about the means of row numbers and known values: xx, yy, xy."""
        a, b = self.inner(lo, hi)
        n = b - a
        k = np.maximum(n, 1)
        si, sii, siy = (p[b] - p[a] for p in self._line)
        sy = self.powers[0][b] - self.powers[0][a]
        xy = np.where(self.constant(lo, hi), 0, siy - si * sy / k)
        return [np.where(n > 0, v.astype(float), np.nan) for v in (sii - si * si / k, self.central(lo, hi)[0], xy)]


def plain_line(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Sums of squares and products about the means of row numbers and running sums of known values (xx, yy, xy), spans side by
    side and each from its own first row on: no digits are lost to rows outside.  As many steps as the longest span has rows."""
    n, run, mx, my, xx, yy, xy = (np.zeros(len(lo)) for _ in range(7))
    for j in range(int((hi - lo).max(initial=0))):
        x = r[np.minimum(lo + j, len(r) - 1)]
        live = (lo + j < hi) & ~np.isnan(x)
        n, run = n + live, np.where(live, run + np.where(live, x, 0), run)
        dx, dy = np.where(live, j - mx, 0), np.where(live, run - my, 0)
        mx, my = mx + dx / np.maximum(n, 1), my + dy / np.maximum(n, 1)
        xx, yy, xy = xx + np.where(live, dx * (j - mx), 0), yy + np.where(live, dy * (run - my), 0), xy + np.where(live, dx * (run - my), 0)
    k = np.maximum(n, 1)
    return [v / k * n for v in (xx, yy, xy)]


def plain_moments(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Sums of the 2nd to 4th powers of known values' deviations from a span's own mean, side by side like ``plain_line``."""
    def each():
        for j in range(int((hi - lo).max(initial=0))):
            x = r[np.minimum(lo + j, len(r) - 1)]
            yield (lo + j < hi) & ~np.isnan(x), x

    n, total = np.zeros(len(lo)), np.zeros(len(lo))
    for live, x in each():
        n, total = n + live, total + np.where(live, x, 0)
    mean, out = total / np.maximum(n, 1), [np.zeros(len(lo)) for _ in range(3)]
    for live, x in each():
        d = np.where(live, x - mean, 0)
        out = [s + p for s, p in zip(out, (d * d, d * d * d, d * d * d * d))]
    return out


def plain_falls(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of squared falls from the highest value so far in a span, side by side like ``plain_line``; gaps have not fallen."""
    peak, out = np.full(len(lo), -np.inf), np.zeros(len(lo))
    for j in range(int((hi - lo).max(initial=0))):
        x = c[np.minimum(lo + j, len(c) - 1)]
        live = (lo + j < hi) & ~np.isnan(x)
        peak = np.where(live, np.maximum(peak, np.where(live, x, 0)), peak)
        d = np.where(live, np.where(live, x, 0) / np.where(live, peak, 1) - 1, 0)
        out += d * d
    return out


class Drawdowns:
    """Falls of positive values from their highest value so far in a span.

    From a value the next higher one is one jump; tables of 1, 2, 4, ... jumps hold the worst fall and the squares
    of all falls on the way, so a span is a few jumps and the rest after its highest value."""

    def __init__(self, series: Series):
        self.series, c = series, series.values
        m = len(c)
        after, waiting = np.full(m + 1, m), []
        for i, v in enumerate(c.tolist()):
            while waiting and c[waiting[-1]] < v:
                after[waiting.pop()] = i
            waiting.append(i)
        self.rows = np.flatnonzero(series.known)
        self.one, self.two = prefix(c), prefix(c * c)
        start = np.arange(m)
        low = series.least.at(start, after[:m])[1] if m else start
        worst = np.concatenate([c[low] / c - 1 if m else c, [np.inf]])
        self.up, self.worst = [after], [(worst, np.concatenate([low, [m]]))]
        self.squares = [np.concatenate([self._squares(start, after[:m]), [0]])]
        while (self.up[-1] < m).any():
            by, (w, p), s = self.up[-1], self.worst[-1], self.squares[-1]
            later = w[by] <= w
            self.worst.append((np.where(later, w[by], w), np.where(later, p[by], p)))
            self.squares.append(s + s[by])
            self.up.append(by[by])

    def _squares(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum of squared falls from the value at start of the values up to end."""
        top = self.series.values[start].astype(np.longdouble)
        one, two = self.one[end] - self.one[start], self.two[end] - self.two[start]
        return np.maximum(two / (top * top) - 2 * one / top + (end - start), 0)

    def at(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        """mdd, its row mdd_row (the last), peak_row (the last row that stands at the top before it), dd2 (sum of
        squares), highs (values above all before them); gaps stand at the top."""
        a, b = self.series.inner(lo, hi)
        some = b > a
        out = {"mdd": np.zeros(len(a)), "mdd_row": hi - 1, "peak_row": hi - 1, "dd2": np.zeros(len(a)), "highs": np.zeros(len(a), np.int64)}
        if not some.any():
            return out
        lo, a, b = lo[some], a[some], b[some]
        at, worst, place = a.copy(), np.zeros(len(a)), a.copy()
        squares, highs = np.zeros(len(a), np.longdouble), np.ones(len(a), np.int64)
        for k in range(len(self.up) - 1, -1, -1):
            go = self.up[k][at] < b
            w, p = self.worst[k][0][at], self.worst[k][1][at]
            take = go & (w <= worst)
            worst, place = np.where(take, w, worst), np.where(take, p, place)
            squares += np.where(go, self.squares[k][at], 0)
            highs += np.where(go, 1 << k, 0)
            at = np.where(go, self.up[k][at], at)
        value, p = self.series.least.at(at, b)
        w = value / self.series.values[at] - 1
        worst, place = np.where(w <= worst, w, worst), np.where(w <= worst, p, place)
        squares += self._squares(at, b)
        top = self.rows[self.series.most.at(a, place + 1)[1]]
        gap = np.maximum.accumulate(np.where(self.series.known, -1, np.arange(len(self.series.x))))[self.rows[place]]
        fell = worst < 0
        out["mdd"][some], out["highs"][some] = worst, highs
        out["dd2"][some] = np.where(fell, squares, 0)
        out["mdd_row"][some] = np.where(fell, self.rows[place], out["mdd_row"][some])
        out["peak_row"][some] = np.where(fell, np.maximum(top, np.where(gap >= lo, gap, -1)), out["peak_row"][some])
        return out
