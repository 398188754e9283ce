"""Token-id output in a static range asymmetric numeral system (rANS) format.

One frequency table, counted over all ids of the corpus, serves every block.
A block interleaves many lanes (each a 64-bit state that renormalises by 32-bit
words), so NumPy codes one id of every lane at a time.  Every so many steps a
checkpoint holds all states; the words between two checkpoints and the states at
the first make a part, which decodes by itself and has a checksum of its own.
Blocks lie in containers of whole documents; a container is one row of a Parquet
table that Spark's own committer writes, so a lost executor's containers are
simply written again.  ``read_ids`` takes a container part by part, ``read_parts``
deals all parts to tasks, however large a document is.

Edge cases: a null or empty text has no ids but the end id; null doc_ids come
first and repeated ones in a fixed order; an empty table gives an empty one;
further columns are ignored; a text of any length is one document of one
container, cut into as many blocks as it needs.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import release, small_batches, stage, table
from .words import claim

#: log2 of the sum of all frequencies in a table.
SCALE = 20
#: Ids in a block, ids in a container before it closes, steps between checkpoints.
BLOCK_IDS, CONTAINER_IDS, CHECKPOINT_STEPS = 1 << 20, 1 << 20, 128
MAX_LANES, IDS_A_LANE = 4096, 64
LOW = np.uint64(1 << 31)
#: Of a part: magic, checksum of the table, ids, lanes, words, scale, checksum of the coded bytes and the ids, whether its block ends with it.
HEAD = struct.Struct("<4sIIIIIII")
MAGIC = b"RNS2"


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each id that occurs."""
    total = counts.astype(np.float64).sum()
    if not total:
        return np.zeros(len(counts), dtype=np.uint32)
    size = 1 << scale
    if np.count_nonzero(counts) > size:
        raise ValueError("more distinct ids than slots; raise the scale")
    exact = counts.astype(np.float64) * size / total
    freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    spare = size - int(freq.sum())
    while spare:
        if spare > 0:
            freq[order[0]] += spare
            break
        room = freq[order] - 1
        cut = np.minimum(room, np.maximum(1, room * -spare // max(1, int(room.sum()))))
        over = np.cumsum(cut) + spare
        cut = np.clip(cut - np.maximum(over, 0), 0, None)
        freq[order] -= cut
        spare += int(cut.sum())
    return freq.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks by one frequency table."""

    def __init__(self, freq: bytes, scale: int = SCALE):
        self.freq = np.frombuffer(freq, dtype=np.uint32).astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.scale = scale
        self.table_crc = zlib.crc32(freq)
        self.slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """The parts of one block."""
        n = len(ids)
        lanes = max(1, min(MAX_LANES, n // IDS_A_LANE))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        freq, start = self.freq[ids], self.start[ids]
        if n and not freq.all():
            raise ValueError("an id that the table does not hold")
        scale, low32, half = np.uint64(self.scale), np.uint64(0xFFFFFFFF), np.uint64(32)
        limit_shift = np.uint64(63 - self.scale)
        words: list[np.ndarray] = []
        parts: list[bytes] = []
        last = steps  # the step at which the part under way ends
        for t in range(steps - 1, -1, -1):
            lo = t * lanes
            f, c = freq[lo : lo + lanes], start[lo : lo + lanes]
            x = state[: len(f)]
            full = x >= (f << limit_shift)
            if full.any():
                words.append((x[full] & low32).astype("<u4"))
                x = np.where(full, x >> half, x)
            q = x // f
            state[: len(f)] = (q << scale) + (x - q * f) + c
            if t % CHECKPOINT_STEPS == 0:
                own = ids[lo : min(n, last * lanes)]
                body = b"".join([state.astype("<u8").tobytes(), *(w.tobytes() for w in reversed(words))])
                parts.append(HEAD.pack(MAGIC, self.table_crc, len(own), lanes, sum(map(len, words)), self.scale, zlib.crc32(own.astype("<u4").tobytes(), zlib.crc32(body)), last == steps) + body)
                words, last = [], t
        return parts[::-1]

    def _slots(self) -> np.ndarray:
        if self.slots is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32
            self.slots = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self.slots

    def decode(self, buf: bytes | memoryview) -> np.ndarray:
        """The ids of one part, which needs no other."""
        magic, table_crc, n, lanes, n_words, scale, crc, ends = HEAD.unpack_from(buf)
        if magic != MAGIC or table_crc != self.table_crc or scale != self.scale or len(buf) != HEAD.size + 8 * lanes + 4 * n_words:
            raise ValueError("not a part of a block of this table")
        state = np.frombuffer(buf, "<u8", lanes, HEAD.size).copy()
        words = np.frombuffer(buf, "<u4", n_words, HEAD.size + 8 * lanes).astype(np.uint64)
        slots, freq, start = self._slots(), self.freq, self.start
        mask, scale_, half = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), np.uint64(32)
        out, pos = np.empty(n, dtype=np.uint32), 0
        for lo in range(0, n, lanes):
            k = min(lanes, n - lo)
            x = state[:k]
            slot = x & mask
            s = slots[slot]
            out[lo : lo + k] = s
            x = freq[s] * (x >> scale_) + slot - start[s]
            need = x < LOW
            m = int(np.count_nonzero(need))
            if m:
                x[need] = (x[need] << half) | words[pos : pos + m]
                pos += m
            state[:k] = x
        # a block ends in the states that its encoder began with
        if pos != n_words or (ends and (state != LOW).any()) or zlib.crc32(out.astype("<u4").tobytes(), zlib.crc32(memoryview(buf)[HEAD.size :])) != crc:
            raise ValueError("a part's checksum does not hold")
        return out


@lru_cache(maxsize=2)
def coder(freq: bytes) -> Coder:
    return Coder(freq)


def pack_blocks(ids: np.ndarray, freq: bytes) -> list[bytes]:
    """The parts of independent blocks, one after another."""
    c = coder(freq)
    return [p for lo in range(0, len(ids), BLOCK_IDS) for p in c.encode(ids[lo : lo + BLOCK_IDS])]


def id_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_ids, ids) of every document; ids: 16-bit (32-bit beyond 65535), compressed."""
    kind = id_kind(path, end_id)

    def each(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo, ids, bounds in tokens.encode_texts(batch.column(1), path, end_id):
                raw, cuts = memoryview(ids.astype(kind).tobytes()), (bounds * np.dtype(kind).itemsize).tolist()
                blobs = [squeeze(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(blobs)), pa.array(np.diff(bounds)), pa.array(blobs, pa.binary())], ["doc_id", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_ids long, ids binary")


def id_kind(path: str, end_id: int) -> str:
    return "<u2" if max(tokens.vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"


def _open(column: pa.Array, kind: str):
    import zstandard

    opened = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(opened(b), dtype=kind) if b else np.empty(0, kind) for b in column.to_pylist()]


def id_counts(rows: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs in all documents, end ids included."""

    def count(batches):
        claim("codes", coder.cache_clear)  # the words that tokenising remembered go
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            part = np.bincount(np.concatenate([np.empty(0, kind), *_open(batch.column(0), kind)]), minlength=len(total))
            part[: len(total)] += total
            total = part
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])

    return rows.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


CONTAINER = "shard int, container int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, parts array<binary>"


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 2, partitions: int | None = None) -> tuple[DataFrame, bytes]:
    """Encode every document in ascending doc_id order; return the written table and its frequencies.

    Texts are tokenised once, into a staged table of compressed ids; these are counted there,
    and coded after one shuffle by ranges of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or tokens.default_path()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = np.zeros(1, dtype=np.int64)
    kind = id_kind(path, end_id)
    tokenised = stage(id_rows(docs, path, end_id), "tokenised", compression="none")
    rows = id_counts(tokenised, kind).collect()  # as many as the vocabulary has ids at most
    if rows:
        counts = np.zeros(max(r["id"] for r in rows) + 1, dtype=np.int64)
        counts[[r["id"] for r in rows]] = [r["n"] for r in rows]
    freq = quantise(counts).tobytes()

    def code(batches):
        from pyspark import TaskContext

        claim("codes", coder.cache_clear)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list = []
        lengths: list[int] = []

        def container():
            nonlocal number, first, ids, doc_ids, lengths
            data = np.concatenate(ids).astype(np.int64)
            row = [[shard], [number], [first], [len(data)], [doc_ids], [lengths], [pack_blocks(data, freq)]]
            number, first = number + 1, first + len(data)
            ids, doc_ids, lengths = [], [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [c.split()[0] for c in CONTAINER.split(", ")])

        held = 0
        for batch in batches:
            for key, got in zip(batch.column(0).to_pylist(), _open(batch.column(1), kind)):
                doc_ids.append(key)
                lengths.append(len(got))
                ids.append(got)
                held += len(got)
                if held >= CONTAINER_IDS:  # close a container after the document that fills it
                    yield container()
                    held = 0
        if doc_ids:
            yield container()

    ordered = tokenised.select("doc_id", "ids").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "ids")
    written = stage(ordered.mapInArrow(code, CONTAINER), "ids", compression="none")
    release(tokenised)
    return written, freq


def _bases(written: DataFrame) -> DataFrame:
    """(shard, base): ids of all shards before; a row a shard, and as many shards as the writer had partitions."""
    shards = written.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return shards.select("shard", (F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))


def read_ids(written: DataFrame, freq: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the coded containers.

    A container's parts follow one another into its task, which holds one part and the document under way."""
    rows = written.select("shard", "first_id", "doc_ids", "lengths", F.posexplode("parts").alias("part", "payload"))
    first = F.col("part") == 0
    rows = rows.select("shard", "first_id", F.when(first, F.col("doc_ids")).alias("doc_ids"), F.when(first, F.col("lengths")).alias("lengths"), "payload")

    def each(batches):
        claim("codes", coder.cache_clear)
        c = coder(freq)
        ends = lens = keys = np.empty(0, np.int64)
        held, seen, done, shard, base = np.empty(0, np.uint32), 0, 0, 0, 0  # seen: ids decoded, done: documents given
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(2)[i].is_valid:
                    shard, base = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    keys, lens = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy().astype(np.int64)
                    ends, held, seen, done = np.cumsum(lens), np.empty(0, np.uint32), 0, 0
                ids = c.decode(batch.column(4)[i].as_buffer())
                held, seen = np.concatenate([held, ids]), seen + len(ids)
                whole = int(np.searchsorted(ends, seen, side="right"))
                if whole > done:
                    at = seen - len(held)  # where held begins
                    raw = memoryview(held.astype("<u4").tobytes())
                    e, n = ends[done:whole], lens[done:whole]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(whole - done, shard, np.int32)), keys.slice(done, whole - done), pa.array(base + e - n), pa.array(n), pa.array([raw[4 * (b - k - at) : 4 * (b - at)] for b, k in zip(e.tolist(), n.tolist())], pa.binary())],
                        ["shard", "doc_id", "local", "n_tokens", "ids"],
                    )
                    held, done = held[ends[whole - 1] - at :], whole

    docs = rows.mapInArrow(each, "shard int, doc_id long, local long, n_tokens long, ids binary")
    return docs.join(F.broadcast(_bases(written)), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def read_parts(written: DataFrame, freq: bytes) -> DataFrame:
    """(shard, container, part, n_ids, ids) of every part, each decoded by itself in whatever task it is dealt to."""
    rows = written.select("shard", "container", F.posexplode("parts").alias("part", "payload"))

    def each(batches):
        claim("codes", coder.cache_clear)
        c = coder(freq)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = c.decode(batch.column(3)[i].as_buffer())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["shard", "container", "part", "n_ids", "ids"])

    return rows.mapInArrow(each, "shard int, container int, part int, n_ids long, ids binary")


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, freq = write_ids(table(spark, sf_dir, "documents"), end_id=2)
    return read_ids(written, freq).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
