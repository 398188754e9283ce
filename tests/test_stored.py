"""A stored table stays whole whatever breaks off, and only what changes is written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barsmith.sources import bars, stored

SCHEMA = "ts_code string, trade_date date, close double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(spark, codes, days, add=0.0):
    return spark.createDataFrame([(c, day(i), i + add) for c in codes for i in days], SCHEMA)


def held(spark, path):
    return {(r["ts_code"], r["trade_date"]): r["close"] for r in stored.read(spark, path).collect()}


def listed(spark, path):
    return {r["ts_code"]: (r["first_day"], r["last_day"], r["rows"]) for r in stored.index(spark, path).collect()}


CODES = [f"C{i}" for i in range(12)]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored.upsert(spark, path, rows(spark, CODES, range(10)), buckets=5) == 1
    return path


def test_upsert_and_index(spark, table):
    before = stored.current(spark, table)
    assert stored.upsert(spark, table, rows(spark, ["C3", "new"], range(8, 12), 0.5)) == 2
    want = {(c, day(i)): float(i) for c in CODES for i in range(10)} | {(c, day(i)): i + 0.5 for c in ("C3", "new") for i in range(8, 12)}
    assert held(spark, table) == want
    assert listed(spark, table) == {c: (day(0), day(11 if c == "C3" else 9), 12 if c == "C3" else 10) for c in CODES} | {"new": (day(8), day(11), 4)}
    after = stored.current(spark, table)
    changed = {b for b in after["data"] if after["data"][b] != before["data"].get(b)}
    own = {str(r[0]) for r in spark.createDataFrame([("C3",), ("new",)], "c string").select(F.pmod(F.xxhash64("c"), F.lit(5))).collect()}
    assert changed == own and after["buckets"] == 5


@pytest.mark.parametrize("step", ["_write_data", "_write_index", "_commit"])
@pytest.mark.parametrize("late", [False, True])
def test_what_breaks_off_leaves_a_whole_table(spark, table, monkeypatch, step, late):
    """A fault before or after any step; after the last one the new version stands."""
    before, real = held(spark, table), getattr(stored, step)

    def broken(*args):
        if late:
            real(*args)
        raise RuntimeError("gone")

    monkeypatch.setattr(stored, step, broken)
    with pytest.raises(RuntimeError):
        stored.upsert(spark, table, rows(spark, ["C1"], range(9, 11), 0.5))
    monkeypatch.undo()
    new = before | {("C1", day(i)): i + 0.5 for i in (9, 10)}
    assert held(spark, table) == (new if step == "_commit" and late else before)
    stored.upsert(spark, table, rows(spark, ["C1"], range(9, 11), 0.5))
    assert held(spark, table) == new and listed(spark, table)["C1"] == (day(0), day(10), 11)
    stored.vacuum(spark, table, 1)
    assert held(spark, table) == new and len(stored._manifests(spark, table)) == 1


def test_half_a_manifest_is_none(spark, table):
    fs, file = stored._path(spark, table, "manifests", f"{2:012d}.json")
    out = fs.create(file, False)
    out.write(bytearray(b'{"number": 2, "buckets": 5, "da'))
    out.close()
    before = held(spark, table)
    assert len(before) == 120 and stored.current(spark, table)["number"] == 1
    assert stored.upsert(spark, table, rows(spark, ["C1"], [20])) == 3
    assert held(spark, table) == before | {("C1", day(20)): 20.0}


def test_a_second_writer_fails(spark, table, monkeypatch):
    """Two updates from one version: the one that commits last does not undo the other."""
    real = stored._commit

    def slow(*args):
        monkeypatch.setattr(stored, "_commit", real)
        stored.upsert(spark, table, rows(spark, ["C2"], [30]))
        real(*args)

    monkeypatch.setattr(stored, "_commit", slow)
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        stored.upsert(spark, table, rows(spark, ["C2"], [40]))
    assert ("C2", day(30)) in held(spark, table) and ("C2", day(40)) not in held(spark, table)


def test_readers_of_an_old_version(spark, table):
    old = stored.read(spark, table)
    stored.upsert(spark, table, rows(spark, CODES, [50]))
    assert old.count() == 120 and stored.read(spark, table).count() == 132


def test_odd_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        stored.read(spark, path)
    assert stored.upsert(spark, path, rows(spark, [], [])) == 0 and stored.index(spark, path).count() == 0
    odd = spark.createDataFrame([(None, day(0), 1.0), ("a", None, 1.0), ("a", day(0), 1.0), ("a", day(0), 2.0), ("a", day(0), None)], SCHEMA)
    assert stored.upsert(spark, path, odd) == 1 and held(spark, path) == {("a", day(0)): 2.0}


def test_plan_equals_one_code_at_a_time(spark, table):
    codes = spark.createDataFrame([(c,) for c in [*CODES, "x", "y", "y"]], "ts_code string")
    stored.upsert(spark, table, rows(spark, ["C1"], range(10, 20)))
    for force in (False, True):
        got = {r["ts_code"]: (r["what"], r["since"]) for r in stored.fetch_plan(codes, stored.index(spark, table), day(15), day(2), 5, force).collect()}
        last = {c: day(19 if c == "C1" else 9) for c in CODES}
        assert got == {c: bars.fetch_window(last.get(c), day(15), day(2), 5, force) for c in [*CODES, "x", "y"]}
