"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A piece goes where the sum, over residual gaps, of the squared number of open
sequences with that gap becomes smallest, be it an open sequence with room or a
new one; of equals, the one that leaves the smallest gap.  Pieces come longest first, so short
ones fill what long ones leave.  Groups of pieces, dealt in turn and so of one
size whatever the rows hold, are packed side by side; a group has so many pieces
that the few sequences it leaves unfilled do not count.

Edge cases: a null or empty text is its end id alone; null or repeated doc_ids
and wholly equal rows are packed like any other, each in a place of its own;
documents over the length are cut and their last piece may be shorter; an empty
table gives an empty one; ``pieces`` ignores further columns, ``pack`` keeps them
but for those named like its result's (``sequence_id``, ``offset``), which give way.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches, stage, table

MAX_IDS = 4096
#: Pieces that one task packs, about; fewer where rows carry ids or other values without a fixed size.
GROUP_PIECES, GROUP_WIDE = 100_000, 4_000


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, max_ids: int = MAX_IDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, cut only beyond max_ids."""
    small_batches(docs.sparkSession)
    path = path or tokens.default_path()

    def cut(batches):
        for batch in batches:
            keys = batch.column(0)
            for lo, ids, bounds in tokens.encode_texts(batch.column(1), path, end_id):
                raw = ids.astype("<u4").tobytes()
                row, piece, start, length = [], [], [], []
                lows = []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    for k, s in enumerate(range(a, b, max_ids)):
                        row.append(lo + i)
                        piece.append(k)
                        start.append(s - a)
                        length.append(min(max_ids, b - s))
                        lows.append(s)
                view = memoryview(raw)
                parts = [view[4 * s : 4 * (s + n)] for s, n in zip(lows, length)]
                cols = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length, taken in the order given."""
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    counts = np.zeros(size + 1, dtype=np.int64)  # counts[g]: open sequences with gap g; full ones (0) stay 0
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    new = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(counts[s:]) + s
        # by how much the sum of squares changes: one sequence less at its gap, one more at the gap that is left
        best, cost = size, (2 * counts[size - s] + 1 if s < size else 0)
        if len(gaps):
            left = gaps - s
            change = np.where(left > 0, 2 * counts[left] + 1, 0) - 2 * counts[gaps] + 1
            k = int(np.argmin(change))  # the first: the smallest gap of equals
            if change[k] <= cost:
                best = int(gaps[k])
        if best == size:
            seq, new = new, new + 1
        else:
            seq = open_at[best].pop()
            counts[best] -= 1
        where[i], offset[i] = seq, size - best
        if best > s:
            open_at[best - s].append(seq)
            counts[best - s] += 1
    return where, offset


def pack(items: DataFrame, max_ids: int = MAX_IDS, group_pieces: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length (1 to max_ids); other columns stay.

    Each row is read by one task, and the rows are dealt in turn: no value of theirs gathers them.  Read from
    files they are dealt alike again, so a task that runs again gives the same."""
    items = items.select(*(c for c in items.columns if c.lower() not in ("sequence_id", "offset")))
    fixed = all(kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp") for _, kind in items.dtypes)
    groups = max(1, -(-items.count() // (group_pieces or (GROUP_PIECES if fixed else GROUP_WIDE))))
    order = [F.desc("length"), "doc_id", "piece", *[c for c, kind in items.dtypes if c not in ("doc_id", "piece", "length") and kind in ("bigint", "int")]]

    def each(batches):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        got = list(batches)
        if got:
            rows = pa.Table.from_batches(got)
            where, offset = sum_of_squares(rows.column("length").to_numpy(), max_ids)
            rows = rows.append_column("sequence_id", pa.array(where + (group << 40))).append_column("offset", pa.array(offset))
            yield from rows.to_batches()

    dealt = items.repartition(groups).sortWithinPartitions(*order)
    kind = ", ".join(f"`{c}` {k}" for c, k in items.dtypes)
    return dealt.mapInArrow(each, f"{kind}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stage(pieces(table(spark, sf_dir, "documents")), "pieces"))  # staged: counted, then packed


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of rows that hold an ids column, joined in order; at most max_ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), "").alias("h")).select("sequence_id", F.unhex("h").alias("ids"))
