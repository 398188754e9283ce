"""Scratch tables, input access and small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session has none and its executors are this machine's (tests) a local folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not known:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barsmith-"))
            known = spark.sparkContext.getCheckpointDir()
        base = known
    return base.rstrip("/")


def tidy() -> None:
    """Give memory that this process has freed back to the system: the driver serves one operator after another, and
    what each collects for a while (a sketch, a sample) would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def stage(df: DataFrame, tag: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barsmith/{tag}-{uuid.uuid4().hex}"
    writer = df.write.options(**({"compression": "zstd"} | options))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barsmith_path = path
    tidy()
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_barsmith_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; rows without an id are never learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


#: Rows and bytes that close an Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


#: Workers serve many stages: memory that one has freed goes back to the system, not into a pool for the next.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_MMAP_THRESHOLD_": str(2 << 20)}


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes of an Arrow batch, as single texts can be very long, and let Python workers
    find this package where they see the driver's files (elsewhere it is shipped with --py-files).

    Both are settings of the session, which only ever come down: every later query keeps them."""
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), home]))
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not held.rstrip("bB").isdigit() or int(held.rstrip("bB")) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
