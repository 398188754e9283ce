"""Fingerprints, filter audit and dominance counts against plain Python."""

import hashlib
import re
import zlib
from functools import cache
from itertools import permutations
from operator import mul

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barsmith.llm import op11_winnow, op12_audit, op13_dominance

BLANK = "[^\x20\x09-\x0d]+"


# --- winnowing ---------------------------------------------------------------------------------------------------


MASK = (1 << 64) - 1


@cache
def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


@cache
def plain_winnow(text, k=op11_winnow.K, w=op11_winnow.W):
    """Hashes by the definition, gram by gram; minima window by window."""
    k = min(k, len(text))
    powers = [pow(op11_winnow.BASE, k - 1 - i, 1 << 64) for i in range(k)]
    codes = [mix((ord(c) + op11_winnow.BASE) & MASK) for c in text]
    grams = [mix(sum(map(mul, codes[i : i + k], powers)) & MASK) for i in range(len(text) - k + 1)] if text else []
    kept = {}
    for s in range(max(1, len(grams) - w + 1) if grams else 0):
        window = grams[s : s + w]
        i = s + len(window) - 1 - window[::-1].index(min(window))
        kept[i] = grams[i]
    return sorted((i, h) for i, h in kept.items())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é中", max_size=90), st.integers(1, 9), st.integers(1, 12))
def test_winnow(text, k, w):
    hashes, places = op11_winnow.winnow(text, k, w)
    assert list(zip(places.tolist(), hashes.tolist())) == plain_winnow(text, k, w)
    again = op11_winnow.decode(op11_winnow.encode(hashes, places)) if text else (hashes, places)
    assert (again[0] == hashes).all() and (again[1] == places).all()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd", max_size=60), st.text(alphabet="abcd", max_size=60), st.text(alphabet="abcd", min_size=14, max_size=30), st.text(alphabet="efgh", max_size=40), st.text(alphabet="efgh", max_size=40))
def test_shared_passages_are_found(a, b, shared, c, d):
    """k + w - 1 code points in common give a common hash; texts without a common k-gram give none."""
    k, w = 6, 9
    one, two = op11_winnow.winnow(a + shared + b, k, w), op11_winnow.winnow(c + shared + d, k, w)
    found = op11_winnow.spans(one, two)
    assert found and all((a + shared + b)[i : i + k] == (c + shared + d)[j : j + k] for i, j in found)
    assert not op11_winnow.spans(op11_winnow.winnow(a, k, w), op11_winnow.winnow("z" * 20, k, w))


def plain_compare(rows):
    """rows: (doc_id, text) with their order settled."""
    out = []
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        q = len(text) // 4
        copy = text[: len(text) - q] + following[:q]
        sets = [{h for _, h in plain_winnow(t)} for t in (text, copy, following)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        prints = [op11_winnow.decode(op11_winnow.encode(*op11_winnow.winnow(t))) if t else (np.empty(0), np.empty(0)) for t in (text, copy)]
        out.append((i, len(text), hashlib.sha256(copy.encode()).hexdigest(), *(sorted(zip(p[1].tolist(), p[0].tolist())) for p in prints), *like))
    return out


def read_back(r):
    prints = [op11_winnow.decode(f) if f else (np.empty(0), np.empty(0)) for f in (r["fingerprint"], r["edited_fingerprint"])]
    return (r["doc_id"], r["n_chars"], r["edited_sha256"], *(sorted(zip(p[1].tolist(), p[0].tolist())) for p in prints), r["near_edited"], r["near_next"])


def test_query_11(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_winnow.op11_winnow(spark, sf).collect()
    assert sorted(map(read_back, got)) == sorted(plain_compare(sorted(docs.items())))
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in got if r["n_chars"] >= 400}
    assert sum(a > b + 0.2 for a, b in near.values()) >= 0.97 * len(near)


def test_winnow_odd_rows(spark, odd, wide, empty):
    assert op11_winnow.compare(empty).collect() == [] and op11_winnow.fingerprints(empty).collect() == []
    rows = [(r["doc_id"], r["text"] or "", r["h"]) for r in odd.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = plain_compare([r[:2] for r in rows])
    key = lambda r: (str(r[0]), r[1:])
    for frame in (odd, wide):
        assert sorted(map(read_back, op11_winnow.compare(frame).collect()), key=key) == sorted(want, key=key)
    one = op11_winnow.compare(odd.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len("The cat sat on the mat and the dog sat on the log.")
    pairs = op11_winnow.fingerprints(odd.where("doc_id = 6")).collect()
    assert [(r["place"], r["hash"] % (1 << 64)) for r in sorted(pairs, key=lambda r: r["place"])][:50] == plain_winnow(next(r[1] for r in rows if r[0] == 6)[:4000])[:50]


# --- filter audit ------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """docs: (doc_id, text, source) rows; every order applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, source in docs:
        text = text or ""
        words = re.findall(BLANK, text)
        fails = "".join(x for x, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > first[text])) if bad)
        parts.setdefault(source or "", []).append((i, fails))
    out = set()
    for part, rows in parts.items():
        made, share = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                kept = [r for r in left if x not in r[1]]
                failing = sum(x in f for _, f in rows)
                share[x] += len(gone)
                made.append((order, step, len(kept), len(gone), failing - len(gone), sum(f == x for _, f in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
                left = kept
        out |= {(part, *m, share[m[0][m[1] - 1]]) for m in made}
    return out


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_odd_rows(spark, odd, wide, empty):
    labels = [(1, 1, None), (2, 0, 1), (2, 1, 0), (6, 1, 1), (7, None, None), (99, 1, 1), (None, 1, 1), (10, 0, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], labels)
    for frame in (odd, wide):
        got = op12_audit.audit(op12_audit.cells(op12_audit.mark_copies(op12_audit.text_masks(frame)), told))
        rows = [tuple(r[n] for n in NAMES) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert op12_audit.audit(op12_audit.cells(op12_audit.mark_copies(op12_audit.text_masks(empty)), told)).collect() == []


def test_query_12_by_hand(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = op12_audit.op12_audit(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {n: "string" if n in NAMES[:2] else "int" if n == "step" else "bigint" for n in NAMES}
    assert {tuple(r[n] for n in NAMES) for r in got.collect()} == plain_audit(docs, labels)


# --- dominance ---------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-3, 3), st.integers(0, 9)), max_size=40))
def test_sweep(rows):
    a, b, w = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    number, total = op13_dominance.above(a, b, w)
    for i, (x, y, _) in enumerate(rows):
        over = [r for r in rows if r[0] < x and r[1] > y]
        assert number[i] == len(over) and total[i] == sum(r[2] for r in over)


def brute(rows):
    out = []
    for i, x, y, w in rows:
        over = [] if x is None or y is None else [r for r in rows if r[1] is not None and r[2] is not None and r[1] < x and r[2] > y]
        out.append((i, x, y, *((None, None) if x is None or y is None else (len(over), sum(r[3] for r in over)))))
    return out


ORDER = dict(key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("strip", [1, 7, 1000])
def test_strips(spark, strip):
    """A third of the points share one x, a third one y; equal rows, nulls; strips from one point on."""
    rng = np.random.default_rng(strip)
    rows = [(i % 150, int(rng.integers(20)) if i % 3 else 5, int(rng.integers(20)) if i % 3 != 1 else 7, int(rng.integers(1, 6))) for i in range(240)]
    rows += [(1000 + i, *v, 2) for i, v in enumerate(((None, 3), (4, None), (None, None), (5, 7), (5, 7)))]
    points = spark.createDataFrame(rows, "sale_id long, x long, y long, weight long")
    op, kept = op13_dominance.isqrt, op13_dominance.isqrt
    op13_dominance.isqrt = lambda n: 0  # strips below 2 * sqrt(n), so that there are many
    try:
        got = op13_dominance.count_above(points, "x", "y", "weight", strip).collect()
    finally:
        op13_dominance.isqrt = kept
    assert sorted(((r["sale_id"], r["x"], r["y"], r["n_above"], r["w_above"]) for r in got), **ORDER) == sorted(brute(rows), **ORDER)
    assert op is kept


def test_dominance_odd_tables(spark):
    points = spark.createDataFrame([], "sale_id long, x long, y long, weight long, n_rows string")
    assert op13_dominance.count_above(points, "x", "y", "weight").collect() == []
    rows = [(1, 1.5, float("nan"), None, "c"), (2, 0.5, 9.0, None, "c"), (3, 1.0, 1.0, 4, None), (4, float("inf"), 0.0, 1, "c")]
    odd = spark.createDataFrame(rows, "sale_id long, x double, y double, weight long, t_n string")
    got = {r["sale_id"]: (r["n_above"], r["w_above"]) for r in op13_dominance.count_above(odd, "x", "y", "weight").collect()}
    assert got == {1: (None, None), 2: (0, 0), 3: (1, 0), 4: (None, None)}


def test_query_13_zone_and_weights(spark, sf):
    want, rows = {}, spark.read.parquet(f"{sf}/sales.parquet").select("sale_id", "total", F.expr("date_format(sold_at, 'yyyy-MM-dd HH:mm:ss')").alias("at")).collect()
    points = []
    for r in rows:
        slot = None if r["at"] is None else int(np.datetime64(r["at"].replace(" ", "T"), "s").astype(int)) // 60
        level = None if r["total"] is None else int(np.floor(100 * r["total"] + 0.5))
        points.append((r["sale_id"], slot, level, 1 + zlib.crc32(str(r["sale_id"]).encode()) % 5))
    known = [p for p in points if p[1] is not None and p[2] is not None]
    s, lv, w = (np.array([p[i] for p in known]) for i in (1, 2, 3))
    for i, x, y, _ in known:
        over = (s < x) & (lv > y)
        want[i] = (x, y, int(over.sum()), int(w[over].sum()))
    want |= {i: (x, y, None, None) for i, x, y, _ in points if x is None or y is None}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r["sale_id"]: tuple(r)[1:] for r in op13_dominance.op13_dominance(spark, sf).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == want
