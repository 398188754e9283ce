"""Portfolios: weights of greatest Sharpe ratio by random search, replay of given actions.

The search adds up codes by the days that they do not know, see ``_by_gaps``; where that is more work, pairs of codes or kinds.

A portfolio's days follow one another, so each is one task's fold; many
portfolios (column `portfolio`) are replayed side by side.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY

DAYS = 252
#: Kinds of codes (a quarter of the codes, where these are paired) of one tile, on average, and the most codes of one.
TILE, CROWD = 128, 1 << 16
#: Codes of a block of covariances; codes and draws of a step over kinds.
BLOCK, CODES, DRAWS = 1024, 8192, 32
#: Most unknown days of a code, and most days of all, that are worked out by sets of unknown days.
GAPS, CALENDAR = 12, 64
#: What a step of these costs, and all of them at least, and what a code in a tile of kinds costs, a pair of codes being one (measured).
STEPS, FIXED, DRAWN = 8, 1 << 24, 500
#: Codes of a set of unknown days that are paired, that are one task with the sets above it, and that are one task; draws of a step.
PAIRED, TASK, PART, STEP = 1024, 8192, 1 << 17, 128
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _fractions(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 to 1 of whole ones, which are used up."""
    y = np.empty_like(x)
    for add in (np.uint64(seed), np.uint64(0)):
        x += add
        for shift, times in ((30, _MIX[0]), (27, _MIX[1]), (31, None)):
            np.right_shift(x, np.uint64(shift), out=y)
            x ^= y
            if times is not None:
                x *= times
    np.right_shift(x, np.uint64(11), out=x)
    return x.view(np.int64) * (1 / (1 << 53))


def draw_weights(codes: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each draw (rows) and code hash (columns), by themselves: no draw knows the other codes."""
    return _fractions(codes.astype(np.uint64)[None, :] + (draws.astype(np.uint64)[:, None] + np.uint64(1)) * _MIX[2], seed)


def _code_weights(codes: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """The same, codes as rows, a cache's worth at a time."""
    add, out = (draws.astype(np.uint64) + np.uint64(1)) * _MIX[2], np.empty((len(codes), len(draws)))
    many = max(1, (1 << 15) // max(1, len(draws)))
    for i in range(0, len(codes), many):
        out[i : i + many] = _fractions(codes[i : i + many, None] + add[None, :], seed)
    return out


def covariance_tile(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Covariances of the columns of two (values, known) matrices over the days that both columns have; 0 below two days."""
    (x, m), (y, k) = a, b
    n = m.T @ k
    mean = (x.T @ k) * (m.T @ y) / np.maximum(n, 1)
    return np.where(n > 1, (x.T @ y - mean) / np.maximum(n - 1, 1), 0.0)


def _by_codes(left: tuple, right: tuple, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain of the left codes, risk of the pair) of each draw: the covariances of all codes, in blocks."""
    gain, risk = np.zeros(draws), np.zeros(draws)
    for i in range(0, len(left[0]), BLOCK):
        codes, x, m = (v[i : i + BLOCK] for v in left)
        w = draw_weights(codes, np.arange(draws), seed)
        gain += w @ (x.sum(axis=1) / m.sum(axis=1))
        for j in range(0, len(right[0]), BLOCK):
            others, y, k = (v[j : j + BLOCK] for v in right)
            v = w if left is right and i == j else draw_weights(others, np.arange(draws), seed)
            risk += ((w @ covariance_tile((x.T, m.T), (y.T, k.T))) * v).sum(axis=1)
    return gain, risk


def _kinds(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, days) of codes that know the same days: rows of m in that order, where each kind starts, its days."""
    packed = np.ascontiguousarray(np.packbits(m.astype(bool), axis=1))
    _, kind = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(kind[order]) > 0]))
    return order, starts, m[order[starts]]


def _by_kinds(left: tuple, right: tuple, kinds: list, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from sums over codes that know the same days: two such codes have their common days in common with all others
    alike, so of a kind only its weighted returns of each day count."""
    (order_a, starts_a, m), (order_b, starts_b, k) = kinds
    n = m @ k.T
    one, two = np.where(n > 1, 1 / np.maximum(n - 1, 1), 0), np.where(n > 1, 1 / np.maximum(n * (n - 1), 1), 0)
    gain, risk, same = np.zeros(draws), np.zeros(draws), left is right
    mean = left[1].sum(axis=1) / left[2].sum(axis=1)

    def summed(side: tuple, order: np.ndarray, starts: np.ndarray, number: np.ndarray, gains: np.ndarray | None) -> np.ndarray:
        out, codes, x, ends = np.zeros((len(starts), len(number), side[1].shape[1])), side[0][order], side[1][order], [*starts[1:].tolist(), len(order)]
        for p, (a, b) in enumerate(zip(starts.tolist(), ends)):
            for i in range(a, b, CODES):
                at = slice(i, min(i + CODES, b))
                w = draw_weights(codes[at], number, seed)
                out[p] += w @ x[at]
                if gains is not None:
                    gains += w @ mean[order[at]]
        return out

    for d in range(0, draws, DRAWS):
        number = np.arange(d, min(d + DRAWS, draws))
        x = summed(left, order_a, starts_a, number, gain[d : d + DRAWS])
        y = x if same else summed(right, order_b, starts_b, number, None)
        products = (one.T @ x.reshape(len(x), -1)).reshape(y.shape) * y
        means = (x @ k.T) * two[:, None, :] * (y @ m.T).transpose(2, 1, 0)
        risk[d : d + DRAWS] = products.sum(axis=(0, 2)) - means.sum(axis=(0, 2))
    return gain, risk


@lru_cache(maxsize=None)
def _differences(order: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences of that order of 1 / (n - 1) and of 1 / (n * (n - 1)), which are 0 below two, at n = 0 to most."""
    n = np.arange(most + order + 1)
    out = []
    for f in (1 / np.maximum(n - 1, 1), 1 / np.maximum(n * (n - 1), 1)):
        f = np.where(n > 1, f, 0.0)
        out.append(sum((-1) ** (order - j) * comb(order, j) * f[j : j + most + 1] for j in range(order + 1)))
    return tuple(out)


def _parted(q: np.ndarray, gaps: np.ndarray, classes: np.ndarray, some: np.ndarray) -> list[tuple[int, int, slice | np.ndarray]]:
    """(class, 0 or place of a day from 1 on, rows) of codes in order of their numbers of unknown days: all of a class, and those
    that do not know one of some days (days that no code knows add nothing)."""
    out = []
    for c, (a, b) in enumerate(zip(np.searchsorted(gaps, classes), np.searchsorted(gaps, classes, side="right"))):
        if a < b:
            out.append((c, 0, slice(a, b)))
            out += [(c, s + 1, a + np.flatnonzero(q[a:b, s])) for s in np.flatnonzero(some & q[a:b].any(axis=0))]
    return out


def _add_up(z: np.ndarray, w: np.ndarray, x: np.ndarray, parted: list) -> None:
    for c, s, at in parted:
        z[c, s] += x[at].T @ w[at]


def _form(z: np.ndarray, order: int, classes: np.ndarray) -> np.ndarray:
    """A set's part of each draw's risk, from weighted returns by class (codes with so many unknown days), unknown day, day."""
    days = z.shape[2]
    one, two = (f[days - classes[:, None] - classes[None, :]] for f in _differences(order, days))
    y, z = z[:, 0], z[:, 1:]
    risk = (np.tensordot(one, y, 1) * y).sum(axis=(0, 1))
    total, by = y.sum(axis=1), np.tensordot(two, y, 1)
    risk -= (np.tensordot(two, total, 1) * total).sum(axis=0) - 2 * (z.sum(axis=2) * by).sum(axis=(0, 1))
    return risk - (np.tensordot(two, z, 1) * z.transpose(0, 2, 1, 3)).sum(axis=(0, 1, 2))


def _below(w: np.ndarray, x: np.ndarray, q: np.ndarray, gaps: np.ndarray, order: int, last: int) -> np.ndarray:
    """The part of each draw's risk (columns of w) of a set of unknown days, whose last is at that place, and of all sets that go
    on from it; codes in order of their numbers of unknown days."""
    days = x.shape[1]
    if len(x) <= PAIRED:
        later, m = q[:, last + 1 :].astype(float), (~q).astype(float)
        n = days - gaps[:, None] - gaps[None, :] + (later @ later.T).astype(int)
        one, two = _differences(order, days)
        shared = x @ m.T
        return (((one[n] * (x @ x.T) - two[n] * shared * shared.T) @ w) * w).sum(axis=0)
    classes, risk = np.unique(gaps), np.zeros(w.shape[1])
    parted = _parted(q, gaps, classes, ~q.all(axis=0))
    for d in range(0, w.shape[1], STEP):
        z = np.zeros((len(classes), days + 1, days, min(STEP, w.shape[1] - d)))
        _add_up(z, w[:, d : d + STEP], x, parted)
        risk[d : d + STEP] = _form(z, order, classes)
    for s in range(last + 1, days):
        at = np.flatnonzero(q[:, s])
        if len(at):
            risk += _below(w[at], x[at], q[at], gaps[at], order + 1, s)
    return risk


def _sums(codes: np.ndarray, x: np.ndarray, q: np.ndarray, gaps: np.ndarray, classes: np.ndarray, draws: int, seed: int, whole: bool):
    """(first draw, weighted returns by class, unknown day, day and draw; gain) of some draws at a time, of a whole set or a part."""
    days, mean = x.shape[1], x.sum(axis=1) / (x.shape[1] - gaps)
    blocks = [slice(i, i + CODES) for i in range(0, len(x), CODES)]
    some = ~q.all(axis=0) if whole else np.ones(days, bool)
    parted = [_parted(q[b], gaps[b], classes, some) for b in blocks]
    for d in range(0, draws, STEP):
        number = np.arange(d, min(d + STEP, draws))
        z, gain = np.zeros((len(classes), days + 1, days, len(number))), np.zeros(len(number))
        for b, p in zip(blocks, parted):
            w = _code_weights(codes[b], number, seed)
            gain += mean[b] @ w
            _add_up(z, w, x[b], p)
        yield d, z, gain


def _table(draws: np.ndarray, gain: np.ndarray, risk: np.ndarray) -> pa.Table:
    return pa.table([pa.array(draws), pa.array(gain), pa.array(risk)], names=["draw", "gain", "risk"])


def _by_gaps(rows: DataFrame, calendar: list[int], limit: int, draws: int, seed: int) -> DataFrame:
    """(draw, gain, risk) in parts, of codes that lack so many days of a calendar at most: without pairs of all codes or kinds.

    Two codes have n = T - a - b + c common days, where a and b are their numbers of unknown days and c that of days that neither
    knows.  A function f of n is the sum over all sets of days that neither knows of f's differences of the set's size at
    T - a - b.  So the risk is a sum over sets of days: each takes the weighted returns of the codes that do not know its days, by a,
    day, and one more unknown day, and squares them.  A code is in 2^a sets, which is a fixed number however many codes there are.
    A set is a task with all sets that go on from it with later days; if it has too many codes, it is a task (or parts, whose
    sums are added up) by itself, and its next sets are dealt in the same way.  Last ones have few codes, which are paired."""
    spark, all_days = rows.sparkSession, F.lit(calendar).cast("array<int>")
    of, set_of = "draw long, gain double, risk double", "array<int>"
    held = rows.select("hash", "days", "x", F.array_except(all_days, "days").alias("gaps"), F.array().cast(set_of).alias("of"), F.lit(-(1 << 31)).alias("last"))
    dealt, groups, split = [], 0, False
    while True:
        found = held.groupBy("of").agg(F.count("*").alias("n"))
        sets, large = found.agg(F.count("*"), F.collect_list(F.when(F.col("n") > TASK, F.struct("of", "n")))).first()
        groups += sets
        big = F.broadcast(spark.createDataFrame([(list(r["of"]), -(-r["n"] // PART)) for r in large], f"of {set_of}, parts int"))
        dealt.append(held.join(big, "of", "left_anti").select("hash", "days", "x", "of", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(True).alias("above")))
        if not large:
            break
        held = held.join(big, "of")
        groups += sum(-(-r["n"] // PART) - 1 for r in large)
        split = split or any(r["n"] > PART for r in large)
        dealt.append(held.select("hash", "days", "x", "of", F.pmod(F.xxhash64("hash"), F.col("parts")).cast("int").alias("part"), "parts", F.lit(False).alias("above")))
        held = held.select("hash", "days", "x", "gaps", "of", F.explode(F.filter("gaps", lambda d: d > F.col("last"))).alias("last"))
        held = held.withColumn("of", F.concat("of", F.array("last")))
    made = dealt[0]
    for more in dealt[1:]:
        made = made.union(more)
    places, classes = np.array(calendar), np.arange(limit + 1)

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = t.combine_chunks()
        days = t.column("days").combine_chunks()
        row, day = np.repeat(np.arange(len(t)), np.diff(days.offsets.to_numpy())), np.searchsorted(places, days.flatten().to_numpy())
        x, q = np.zeros((len(t), len(places))), np.ones((len(t), len(places)), bool)
        x[row, day], q[row, day] = t.column("x").combine_chunks().flatten().to_numpy(), False
        gaps = q.sum(axis=1)
        order = np.argsort(gaps, kind="stable")
        return t.column("hash").to_numpy().view(np.uint64)[order], x[order], q[order], gaps[order]

    def whole(t: pa.Table) -> pa.Table:
        of, above = t.column("of")[0].as_py(), t.column("above")[0].as_py()
        codes, x, q, gaps = read(t)
        gain, risk = np.zeros(draws), np.zeros(draws)
        if above:
            last, mean = (int(np.searchsorted(places, of[-1])) if of else -1), x.sum(axis=1) / (len(places) - gaps)
            for d in range(0, draws, 2048):
                w = _code_weights(codes, np.arange(d, min(d + 2048, draws)), seed)
                gain[d : d + 2048], risk[d : d + 2048] = mean @ w, _below(w, x, q, gaps, len(of), last)
        else:
            own = np.unique(gaps)
            for d, z, g in _sums(codes, x, q, gaps, own, draws, seed, True):
                gain[d : d + STEP], risk[d : d + STEP] = g, _form(z, len(of), own)
        return _table(np.arange(draws), gain * (not of), risk)

    def part(t: pa.Table) -> pa.Table:
        of, rows = t.column("of")[0].as_py(), []
        for d, z, g in _sums(*read(t), classes, draws, seed, False):
            rows.append(pa.table([pa.array([of], pa.list_(pa.int32())), pa.array([d], pa.int32()), pa.array([z.tobytes()]), pa.array([g.tobytes()])], names=["of", "first", "z", "gain"]))
        return pa.concat_tables(rows)

    def joined(t: pa.Table) -> pa.Table:
        of, d = t.column("of")[0].as_py(), t.column("first")[0].as_py()
        gain, z = (sum(np.frombuffer(v.as_buffer()) for v in t.column(n)) for n in ("gain", "z"))
        risk = _form(z.reshape(len(classes), len(places) + 1, len(places), len(gain)), len(of), classes)
        return _table(np.arange(d, d + len(gain)), gain * (not of), risk)

    # the number of tasks is given: rows are few for the work that they make
    out = made.where("parts = 1").repartition(min(max(groups, 1), 1024), "of").groupBy("of").applyInArrow(whole, of)
    if not split:
        return out
    parted = made.where("parts > 1").repartition(min(max(groups, 1), 256), "of", "part").groupBy("of", "part").applyInArrow(part, f"of {set_of}, first int, z binary, gain binary")
    return out.union(parted.groupBy("of", "first").applyInArrow(joined, of))


def _gap_limit(rows: DataFrame, calendar: list[int], codes: int, pairs: int) -> tuple[int, int]:
    """(most unknown days of codes that go by sets of unknown days, codes that lack more): what takes the fewest steps; -1 if none.

    Such codes have two days in common with each other whatever they lack, so differences are small and keep their digits."""
    best, held = (pairs, -1, codes), {}
    if 1 < len(calendar) <= CALENDAR and pairs > FIXED:
        held = dict(rows.groupBy((F.lit(len(calendar)) - F.size(F.array_distinct("days"))).alias("gaps")).count().collect())
    steps, left = FIXED, codes
    for a in range(min(GAPS, (len(calendar) - 2) // 2) + 1 if held else 0):
        steps += held.get(a, 0) * STEPS * (1 << a) * (1 + a) * len(calendar)
        left -= held.get(a, 0)
        best = min(best, (steps + pairs * (1 - (1 - left / codes) ** 2), a, left))
    return best[1:]


def _known(panel: DataFrame) -> DataFrame:
    """(hash, days, x): a row a code, with the days of its returns."""
    known = F.sort_array(F.collect_list(F.struct(F.unix_date(DATE).alias("day"), F.col("log_return").alias("x"))))
    rows = panel.where("log_return IS NOT NULL").groupBy(KEY).agg(known.alias("known"))
    return rows.select(F.xxhash64(KEY).alias("hash"), F.col("known.day").alias("days"), F.col("known.x").alias("x"))


def search(panel: DataFrame, draws: int = 10_000, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(draw, gain, risk): yearly mean and variance of so many random portfolios, their weights up to a factor.

    A code is one row with its days and returns.  Codes that know the same days are of one kind, and covariances over common days
    depend on a code's kind and returns alone, so a draw's risk is a sum over pairs of kinds of its weighted returns by day: codes
    are gone through, not paired.  Tiles of kinds are dealt in pairs, each pair one task, and one row a draw comes out of it.
    Where kinds are nearly as many as codes, pairs of codes are fewer steps, and tiles hold codes (their covariances, in blocks).
    Of a short calendar, codes that lack few days go by sets of unknown days (``_by_gaps``), in steps that grow with the codes;
    only the others are paired, with all."""
    return _search(_known(panel), draws, seed, tile)


def _search(rows: DataFrame, draws: int, seed: int, tile: int) -> DataFrame:
    sizes = rows.groupBy("days").agg(F.count("*").alias("n"))
    kinds, codes, most, longest = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max(F.size("days")), F.lit(0))).first()
    salts = -(-most // CROWD) or 1  # parts of the largest kind
    paired = codes * codes <= 3 * longest * (kinds * salts) ** 2
    at, tiles = _tiles(codes, kinds, salts, paired, tile)
    limit, left, made = -1, codes, None
    pairs = codes * codes if paired else 3 * longest * (kinds * salts) ** 2 + DRAWN * codes * (tiles + 1)
    if longest <= CALENDAR and pairs > FIXED:
        calendar = sorted(r[0] for r in sizes.select(F.explode("days")).distinct().limit(CALENDAR + 1).collect())
        limit, left = _gap_limit(rows, calendar, codes, pairs)
    if limit >= 0:
        few = F.size(F.array_distinct("days")) >= len(calendar) - limit
        made = _by_gaps(rows.where(few), calendar, limit, draws, seed)
    if left:
        tiled = _by_tiles(rows, draws, seed, at, tiles) if limit < 0 else _by_tiles(rows, draws, seed, F.col("hash"), -(-left // (4 * tile)), few, -(-codes // CODES))
        made = tiled if made is None else made.union(tiled)
    if made is None:
        made = rows.sparkSession.createDataFrame([], "draw long, gain double, risk double")
    return made.groupBy("draw").agg((F.sum("gain") * DAYS).alias("gain"), (F.sum("risk") * DAYS).alias("risk"))


def _tiles(codes: int, kinds: int, salts: int, paired: bool, tile: int) -> tuple[Column, int]:
    """What deals rows to tiles, and how many tiles."""
    tiles = max(1, -(-codes // (4 * tile)) if paired else max(-(-kinds * salts // tile), -(-codes // CROWD)))
    return (F.col("hash") if paired else F.xxhash64("days", F.pmod("hash", F.lit(salts)))), tiles


def _by_tiles(rows: DataFrame, draws: int, seed: int, at: Column, tiles: int, done: Column | None = None, others: int = 0) -> DataFrame:
    """(draw, gain, risk) in parts, one for each pair of tiles; codes that are done have tiles of their own, which are paired with
    those of other codes only."""
    i, last = F.pmod(at, F.lit(tiles)), F.lit(tiles - 1)
    if done is not None:
        i, last = F.when(done, tiles + F.pmod(at, F.lit(others))).otherwise(i), F.when(done, last).otherwise(tiles + others - 1)
    rows = rows.withColumn("i", i)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("hash", "days", "x", "i", F.least("i", "other").alias("a"), F.greatest("i", "other").alias("b"))

    def each(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        i, code = t.column("i").to_numpy(), t.column("hash").to_numpy().view(np.uint64)
        held = t.column("days").combine_chunks()
        row = np.repeat(np.arange(len(t)), np.diff(held.offsets.to_numpy()))
        days, day = np.unique(held.flatten().to_numpy(), return_inverse=True)
        x, m = np.zeros((len(t), len(days))), np.zeros((len(t), len(days)))
        x[row, day], m[row, day] = t.column("x").combine_chunks().flatten().to_numpy(), 1
        left = tuple(v[i == a] for v in (code, x, m))
        right = left if a == b else tuple(v[i == b] for v in (code, x, m))
        if not len(left[0]) or not len(right[0]):  # a tile without codes
            return _table(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        kinds = [_kinds(left[2])]
        kinds.append(kinds[0] if a == b else _kinds(right[2]))
        if len(left[0]) * len(right[0]) <= 3 * len(days) * len(kinds[0][1]) * len(kinds[1][1]):
            gain, risk = _by_codes(left, right, draws, seed)
        else:
            gain, risk = _by_kinds(left, right, kinds, draws, seed)
        return _table(np.arange(draws), gain * (a == b), risk * (1 if a == b else 2))

    # the number of tasks is given: rows are few for the work that they make
    return rows.repartition(min(4 * (tiles * (tiles + 1) // 2 + tiles * others), 1024), "a", "b").groupBy("a", "b").applyInArrow(each, "draw long, gain double, risk double")


def max_sharpe(panel: DataFrame, draws: int = 10_000, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(ts_code, weight, sharpe): of so many random portfolios, each drawn by its own number, the one of greatest Sharpe ratio."""
    rows = _known(panel).persist()  # counted some times before it is searched
    try:
        best = _search(rows, draws, seed, tile).select("draw", (F.col("gain") / F.sqrt(F.greatest("risk", F.lit(1e-300)))).alias("sharpe")).orderBy(F.desc("sharpe"), "draw").first()
        if best is None:
            return panel.sparkSession.createDataFrame([], f"{KEY} string, weight double, sharpe double")
        number = best["draw"]

        @F.pandas_udf("double")
        def weight(hashes: pd.Series) -> pd.Series:
            return pd.Series(draw_weights(hashes.to_numpy().view(np.uint64), np.array([number]), seed)[0])

        total = rows.agg(F.sum(weight("hash"))).first()[0]
    finally:
        rows.unpersist()
    codes = panel.where("log_return IS NOT NULL").select(KEY).distinct().select(KEY, weight(F.xxhash64(KEY)).alias("w"))
    return codes.select(KEY, (F.col("w") / F.lit(total)).alias("weight"), F.lit(best["sharpe"]).alias("sharpe"))


def remainder(before: np.ndarray, after: np.ndarray, fee: float) -> float:
    """The share of wealth that is left when weights (cash first) are changed at a fee, by its fixed point.

    Only what is sold pays; a start from cash alone is free."""
    now, last = 1 - 2 * fee + fee * fee, 1.0
    while abs(now - last) > 1e-10:
        last = now
        sold = np.maximum(before[1:] - now * after[1:], 0).sum()
        now = (1 - fee * after[0] - (2 * fee - fee * fee) * sold) / (1 - fee * after[0])
    return now


def _wide(pdf: pd.DataFrame, column: str) -> pd.DataFrame:
    return pdf.pivot_table(index=DATE, columns=KEY, values=column, aggfunc="first", dropna=False).sort_index()


def replay_weights(actions: DataFrame, amount: float = 10_000.0, fee: float = 0.0025) -> DataFrame:
    """(portfolio, trade_date, value, log_return) of actions (portfolio, trade_date, ts_code, close, action, cash_action).

    Each date's weights are the softmax of its actions, cash among them; they are bought at the date's close,
    which costs a fee on what changes, and hold until the next date, when prices have moved them.  A missing
    price stands still, a missing action is 0."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        price = _wide(pdf, "close").ffill()
        act = _wide(pdf, "action").fillna(0.0).to_numpy()
        cash = pdf.groupby(DATE)["cash_action"].first().sort_index().fillna(0.0).to_numpy()
        moved = (price / price.shift(1)).fillna(1.0).to_numpy()
        held, value, values, gains = np.array([1.0] + [0.0] * price.shape[1]), amount, [amount], [0.0]
        for t in range(len(price) - 1):
            x = np.concatenate([[cash[t]], act[t]])
            w = np.exp(x - x.max())
            w /= w.sum()
            value *= remainder(held, w, fee)
            parts = value * w * np.concatenate([[1.0], moved[t + 1]])
            value = parts.sum()
            held = parts / value
            gains.append(float(np.log(value / values[-1])))
            values.append(float(value))
        return pd.DataFrame({"portfolio": pdf["portfolio"].iloc[0], DATE: list(price.index), "value": values, "log_return": gains})

    rows = actions.select("portfolio", DATE, KEY, "close", "action", "cash_action")
    return rows.groupBy("portfolio").applyInPandas(each, f"portfolio string, {DATE} date, value double, log_return double")


def replay_allocations(actions: DataFrame, penalty: float = 0.1, window: int = 22) -> DataFrame:
    """(portfolio, trade_date, value, reward) of actions (portfolio, trade_date, ts_code, log_return, action).

    A date earns by the weights that the date before set (equal ones first); the reward is the log return less
    a penalty on the deviation of the last so many returns, once there are as many."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        returns, act = _wide(pdf, "log_return"), _wide(pdf, "action").fillna(0.0).to_numpy()
        w, value, values, rewards, seen = np.full(returns.shape[1], 1 / returns.shape[1]), 1.0, [], [], []
        for t, r in enumerate(returns.fillna(0.0).to_numpy()):
            gain = float(w @ r)
            seen.append(gain)
            value *= float(np.exp(gain))
            rewards.append(gain - (penalty * float(np.std(seen[-window:])) if len(seen) >= window else 0.0))
            values.append(value)
            w = act[t]
        return pd.DataFrame({"portfolio": pdf["portfolio"].iloc[0], DATE: list(returns.index), "value": values, "reward": rewards})

    rows = actions.select("portfolio", DATE, KEY, "log_return", "action")
    return rows.groupBy("portfolio").applyInPandas(each, f"portfolio string, {DATE} date, value double, reward double")
