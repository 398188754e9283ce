"""A stored table of bars that is updated in part and always read whole.

Codes are dealt to a fixed number of buckets by a hash.  A version of the table is a
manifest, a small file that names each bucket's folder and the folder of the index
(code, first and last day, rows).  An update writes new folders for the buckets that
change, a new index, and at last a new manifest; the manifest with the highest number
that is complete is the table.  What breaks off before that leaves folders that nothing
names, so at every moment a reader sees one whole version, and readers of an older
one keep its files until ``vacuum``.  A manifest is created only where there is none of
its number: of two writers that started from one version, the later one fails and can try
again.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.dialect import DATE, KEY
from barsmith.sources import bars

#: Buckets of a new table.
BUCKETS = 64


def _path(spark: SparkSession, *parts: str):
    target = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the manifests, newest first."""
    fs, folder = _path(spark, path, "manifests")
    return sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []


def _load(spark: SparkSession, path: str, name: str) -> dict | None:
    """A manifest, None if it was not written to its end."""
    fs, file = _path(spark, path, "manifests", name)
    stream = fs.open(file)
    try:
        text = bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if found.get("end") else None


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest complete manifest."""
    return next((m for n in _manifests(spark, path) if (m := _load(spark, path, n))), None)


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write a manifest under the next number; fails if another writer has taken it."""
    fs, file = _path(spark, path, "manifests", f"{manifest['number']:012d}.json")
    stream = fs.create(file, False)
    try:
        stream.write(bytearray(json.dumps(manifest | {"end": True}).encode()))
    finally:
        stream.close()


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame | None:
    return spark.read.parquet(*(f"{path.rstrip('/')}/{f}" for f in folders)) if folders else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """All bars of the current version."""
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no table in {path}")
    return _read(spark, path, sorted(set(now["data"].values())))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(ts_code, first_day, last_day, rows) of every code in the current version."""
    now = current(spark, path)
    if now is None:
        return spark.createDataFrame([], f"{KEY} string, first_day date, last_day date, rows long")
    return _read(spark, path, [now["index"]]).drop("bucket")


def summarise(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(KEY, *by).agg(F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day"), F.count("*").alias("rows"))


def fetch_plan(codes: DataFrame, known: DataFrame, last_trading_day: date | str, start: date | str, overlap_days: int = 5, force: bool = False) -> DataFrame:
    """(ts_code, what, since) of all codes in one join with the index: 'skip' what is up to date, fetch 'incremental' from
    some days before the last one, 'full' from the start for new codes or if forced."""
    day = lambda d: F.lit(d).cast("date")
    rows = codes.select(KEY).distinct().join(known.select(KEY, "last_day"), KEY, "left")
    what = F.when(F.col("last_day").isNull() | F.lit(force), "full").when(F.col("last_day") >= day(last_trading_day), "skip").otherwise("incremental")
    since = F.when(F.col("what") == "full", day(start)).when(F.col("what") == "incremental", F.greatest(day(start), F.date_sub("last_day", overlap_days)))
    return rows.withColumn("what", what).select(KEY, "what", since.alias("since"))


def _write_data(rows: DataFrame, path: str, folder: str) -> None:
    rows.write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/{folder}")


def _write_index(rows: DataFrame, path: str, folder: str) -> None:
    rows.write.parquet(f"{path.rstrip('/')}/{folder}")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: tuple[str, ...] = (KEY, DATE), buckets: int = BUCKETS) -> int:
    """Put rows into the table, a new one for an old one of equal keys; returns the number of the new version.

    Only buckets with new rows are read and written again.  Rows without a code or a day are left out."""
    now = current(spark, path)
    many = now["buckets"] if now else buckets
    number, mark = max([int(n[:12]) for n in _manifests(spark, path)], default=0) + 1, uuid.uuid4().hex
    bucket = F.pmod(F.xxhash64(KEY), F.lit(many)).cast("int")
    new = new.dropna(subset=list(keys)).withColumn("bucket", bucket)
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return now["number"] if now else 0
    data = dict(now["data"]) if now else {}
    old = _read(spark, path, sorted({data[str(b)] for b in touched if str(b) in data}))
    both = bars.upsert(old.withColumn("bucket", bucket), new, keys) if old is not None else bars.keep_one(new, keys)
    _write_data(both, path, f"data/{mark}")
    data |= {str(b): f"data/{mark}/bucket={b}" for b in touched}
    fresh = summarise(spark.read.parquet(f"{path.rstrip('/')}/data/{mark}"), "bucket")
    if now:
        fresh = _read(spark, path, [now["index"]]).where(~F.col("bucket").isin(touched)).unionByName(fresh)
    _write_index(fresh, path, f"index/{mark}")
    _commit(spark, path, {"number": number, "buckets": many, "data": data, "index": f"index/{mark}"})
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete folders that none of the newest versions names, and older manifests.  No writer may be at work."""
    names = _manifests(spark, path)
    whole = [(n, m) for n in names if (m := _load(spark, path, n))][:keep]
    used = {f for _, m in whole for f in (m["index"], *m["data"].values())}
    for n in names:
        if n not in {k for k, _ in whole}:
            fs, file = _path(spark, path, "manifests", n)
            fs.delete(file, False)
    for kind in ("data", "index"):
        fs, folder = _path(spark, path, kind)
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f"{kind}/{f.getPath().getName()}"
            if not any(u == name or u.startswith(f"{name}/") for u in used):
                fs.delete(f.getPath(), True)
