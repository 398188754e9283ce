"""N-gram Jaccard join: rare-first prefix filtering, components of the links.

1. One pass gives each document its set of word shingles (64-bit hashes), a class
   (documents with one and the same set are one class, however many) and counts
   all shingles in a sketch of fixed size.  Any fixed order of shingles keeps
   prefix filtering exact; the sketch makes that order put rare ones first.
2. A second pass emits each class's prefix: its rarest n - ceil(t * n) + 1
   shingles with their positions.  Rows meet by shingle; those that meet no other
   class go.
3. Links are found in rounds.  A round pairs, within the rows of a shingle, the
   one that stands first in its own order with each row of another component.  The last round
   pairs all rows that are then still in different components.  So a group of
   near copies costs about a pair a copy, not all pairs, and yet no link between
   two components is missed: every candidate pair is either tried or lies within
   one component already.
4. A candidate pair passes the length filter and the positional filter where the
   rows meet, then the suffix filter (how many shingles either set has in each of
   256 hash ranges bounds their overlap), and is verified once on the sets.
5. Components come from large and small stars; nothing is collected.

Edge cases: null, empty and blank texts have no shingle and link with nothing;
fewer words than k make one shingle of all of them; a null doc_id takes part but
never names a component unless no other member has an id; repeated doc_ids are
rows of their own; an empty table gives an empty one; further columns are
ignored by ``link`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, stage, table
from .components import components
from .words import claim, slices

#: log2 of the counters in the sketch, and counters in one row of it: 32 MB sent to tasks, whatever the input.
SKETCH, CHUNK = 25, 1 << 19
#: Bits of a shingle's hash that its rows are dealt without.
DROPPED = np.uint64(16)
#: log2 of the bits that tell which documents' texts are read again.
FILTER_BITS = 23
#: Hash ranges in which shingles are counted for the suffix filter; sets up to FEW shingles have a quarter as many.
RANGES, FEW = 256, 800
#: Rounds with one pairing row a shingle, before the round with all; rows of a shingle that are paired at once there.
STAR_ROUNDS, BLOCK = 2, 2048
#: Rows of one shingle up to which such groups are paired side by side.
SMALL = 8
#: Counted classes up to which their names are broadcast.
BROADCAST_ROWS = 500_000
A, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text of a column."""
    claim("shingles", lambda: None)
    lowered = pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for t in slices(lowered):
        vocab = pd.util.hash_array(t.vocab.to_numpy(zero_copy_only=False), categorize=False) if len(t.vocab) else np.empty(0, np.uint64)
        w = _scramble(vocab[t.codes] + A) if len(t.codes) else np.empty(0, np.uint64)
        h = w[: max(0, len(w) - k + 1)].copy()
        for i in range(1, k):
            h = h * A + w[i : i + len(h)]
        h = _scramble(h)
        bounds = t.bounds.tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= k:
                yield np.unique(h[a : b - k + 1])
            elif b > a:  # all words as one, told apart by their number
                one = np.array([b - a], dtype=np.uint64)
                for i in range(a, b):
                    one = _scramble(one * A + w[i : i + 1])
                yield one
            else:
                yield np.empty(0, dtype=np.uint64)


def class_of(s: np.ndarray) -> int:
    """64 bits of a digest of a set: documents with one set share it."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def ranges(s: np.ndarray) -> bytes | None:
    """How many shingles lie in each range of hashes, a byte each: RANGES, or of small sets a quarter as many;
    None, which filters nothing, where a byte cannot say."""
    fine = len(s) > FEW
    found = np.bincount((s >> np.uint64(56 if fine else 58)).astype(np.int64), minlength=RANGES if fine else RANGES // 4)
    return found.astype(np.uint8).tobytes() if found.max() <= 255 else None


def may_link(a, b, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether pairs pass the suffix filter; a, b: binary columns of ranges, n, m: set sizes."""
    out = np.ones(len(n), dtype=bool)
    for lo in range(0, len(n), 20_000):
        some, other = (v[lo : lo + 20_000].to_pylist() for v in (a, b))
        for fine in (True, False):  # pairs with ranges of both in full, and those whose full ones are added up in fours
            at = [i for i, (v, w) in enumerate(zip(some, other)) if v and w and (len(v) == len(w) == RANGES) == fine]
            if not at:
                continue
            width = RANGES if fine else RANGES // 4
            x, y = (np.stack([np.frombuffer(side[i], np.uint8).astype(np.int32).reshape(width, -1).sum(axis=1) for i in at]) for side in (some, other))
            at = np.array(at) + lo
            out[at] = np.minimum(x, y).sum(axis=1) >= least_overlap(n[at], m[at], num, den)
    return out


def least_overlap(n, m, num: int, den: int):
    """Common shingles that sets of n and m need at least: ceil(t / (1 + t) * (n + m))."""
    return (num * (n + m) + num + den - 1) // (num + den)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds from one pass: (doc_id, cls, n, ranges) a document, (chunk, counts) of the sketch.

    A task counts a class once, as far as it remembers, and its counters stop at 65535.  Each task writes a
    sketch of its own, so there are as many tasks as the cluster has cores, a few times over, not as many as files."""

    def each(batches):
        import zstandard

        counts = np.zeros(1 << SKETCH, dtype=np.uint16)
        seen: set[int] = set()
        mask = np.uint64((1 << SKETCH) - 1)
        for batch in batches:
            cls, sizes, spread, new = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                spread.append(ranges(s))
                if len(s) and cls[-1] not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(cls[-1])
                    new.append((s & mask).astype(np.uint32))
            if new:
                cells, times = np.unique(np.concatenate(new), return_counts=True)
                counts[cells] = np.minimum(counts[cells] + times, 65535)
            n = len(sizes)
            yield _profile_batch(batch.column(0), cls, sizes, spread, [None] * n, [None] * n)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for i in range((1 << SKETCH) // CHUNK):
            part = counts[i * CHUNK : (i + 1) * CHUNK]
            if part.any():
                bits = squeeze(np.packbits(part > 0).tobytes())
                yield _profile_batch(pa.nulls(1, pa.int64()), [None], [None], [None], [i], [len(bits).to_bytes(4, "little") + bits + squeeze(part[part > 0].astype("<u2").tobytes())])

    few = max(1, 4 * docs.sparkSession.sparkContext.defaultParallelism)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").coalesce(few).mapInArrow(each, "doc_id long, cls long, n long, ranges binary, chunk int, counts binary")


def _profile_batch(ids, cls, sizes, spread, chunk, counts):
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spread, pa.binary()), pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())],
        ["doc_id", "cls", "n", "ranges", "chunk", "counts"],
    )


def _sketch(rows: DataFrame) -> np.ndarray:
    """The summed sketch on a scale of eighths of a doubling, a byte a counter; parts are added up by chunk as they stream by."""

    def add(batches):
        import zstandard

        opened = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = 4 + int.from_bytes(counts[:4], "little")
                part = np.unpackbits(np.frombuffer(opened(counts[4:size]), np.uint8)).astype(np.uint16)
                part[part > 0] = np.frombuffer(opened(counts[size:]), dtype="<u2")
                if chunk not in sums:
                    sums[chunk] = np.zeros(CHUNK, dtype=np.int64)
                sums[chunk] += part
        level = [np.minimum(255, np.round(8 * np.log2(v + 1.0))).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["chunk", "counts"])

    parts = rows.where("chunk is not null").select("chunk", "counts")
    got = parts.repartition((1 << SKETCH) // CHUNK, "chunk").mapInArrow(add, "chunk int, counts binary").toArrow()  # 32 MB
    out = np.zeros(1 << SKETCH, dtype=np.uint8)
    for chunk, counts in zip(got.column("chunk"), got.column("counts")):
        out[chunk.as_py() * CHUNK : (chunk.as_py() + 1) * CHUNK] = np.frombuffer(counts.as_buffer(), dtype=np.uint8)
    return out


def _prefixes(docs: DataFrame, k: int, num: int, den: int, sent) -> DataFrame:
    """(token, cls, n, pos): each class's rarest shingles by a broadcast sketch; a class is emitted once a task.

    A token is the upper part of a shingle's hash: rows that meet by it alone are candidates like others."""

    def each(batches):
        counts = sent.value
        seen: set[int] = set()
        for batch in batches:
            tokens, owners, sizes, places = [], [], [], []
            for s in shingle_sets(batch.column(0), k):
                n = len(s)
                if not n or (cls := class_of(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(cls)
                p = n - (num * n + den - 1) // den + 1
                freq = counts[(s & np.uint64((1 << SKETCH) - 1)).astype(np.int64)].astype(np.uint64)
                order = np.argsort((freq << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[:p]
                tokens.append((s[order] >> DROPPED).view(np.int64))
                owners.append(np.full(p, cls, dtype=np.int64))
                sizes.append(np.full(p, n, dtype=np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, owners, sizes, places)], ["token", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(each, "token long, cls long, n int, pos int")


def _shared(rows: DataFrame) -> DataFrame:
    """The distinct rows whose shingle some other class holds too, each with the shingle's head: the row that has it earliest.

    Rows are dealt and sorted by shingle once and stream by: all that is held of a shingle is its head and its last row."""

    def each(batches):
        last, known, head = None, False, None  # the row before, whether its shingle is known to be shared, and its head
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            token, cls, pos = (batch.column(i).to_numpy() for i in (0, 1, 3))
            same = np.concatenate([[False], token[1:] == token[:-1]])
            again = same & np.concatenate([[False], (cls[1:] == cls[:-1]) & (pos[1:] == pos[:-1])])  # one row of a class twice
            run = np.cumsum(~same) - 1
            met = np.zeros(run[-1] + 1, dtype=bool)
            met[run[same & ~again]] = True
            take = ~again
            if known:
                met[0], take[0] = True, False  # the row before has been given
            starts = np.flatnonzero(~same)
            heads = [batch.column(i).to_numpy()[starts] for i in (1, 2, 3)]
            if head is not None:
                heads = [np.concatenate([[first], rest[1:]]).astype(rest.dtype) for first, rest in zip(head, heads)]
            keep = met[run] & take
            if keep.any():
                own = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(h[run[keep]]) for h in heads)], [*own.schema.names, "head", "head_n", "head_pos"])
            last, known, head = batch.slice(batch.num_rows - 1, 1), bool(met[-1]), [h[-1] for h in heads]

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "token").sortWithinPartitions("token", "pos", "cls")
    return ordered.mapInArrow(each, "token long, cls long, n int, pos int, head long, head_n int, head_pos int")


def _possible(n: str, pos: str, m: str, mpos: str, num: int, den: int) -> Column:
    """Length and positional filter of a pair that shares a shingle at these places."""
    a, b = F.col(n).cast("long"), F.col(m).cast("long")
    lengths = (F.least(a, b) * den >= F.greatest(a, b) * num)
    room = F.least(a - F.col(pos), b - F.col(mpos)) + F.least(F.col(pos), F.col(mpos))
    # a pair that links also shares a shingle that is so early in both that the rest alone could not hold the overlap
    early = ((a - F.col(pos)) * (num + den) >= (a + b) * num) & ((b - F.col(mpos)) * (num + den) >= (a + b) * num)
    return lengths & early & (room * (num + den) >= (a + b) * num)


def _all_pairs(rows: DataFrame, classes: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(a, b, n, m): pairs of rows with one token and different roots that pass all filters.

    rows: (token, cls, n, pos, root), classes: (cls, ranges).  A token's rows are dealt to blocks, and each pair of blocks is one
    piece of work of bounded size, in which only the pairs that pass are ever made rows."""
    counts = rows.groupBy("token").agg(F.count("*").alias("rows"))
    dealt = rows.join(counts, "token").withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = dealt.withColumn("side", F.explode(sides)).select("token", F.col("side.i").alias("i"), F.col("side.j").alias("j"), "own", "cls", "n", "pos", "root")
    dealt = dealt.join(classes.select("cls", "ranges"), "cls").select("token", "i", "j", "own", "cls", "n", "pos", "root", "ranges")

    def made(t: dict, a: np.ndarray, b: np.ndarray):
        """The pairs of rows a and b that pass all filters, if any."""
        root, n, pos, cls = t["root"], t["n"], t["pos"], t["cls"]
        ok = (root[a] != root[b]) & (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num)
        least = least_overlap(n[a], n[b], num, den)
        ok &= np.minimum(n[a] - pos[a], n[b] - pos[b]) + np.minimum(pos[a], pos[b]) >= least
        ok &= (n[a] - pos[a] >= least) & (n[b] - pos[b] >= least)  # as in _possible
        a, b = a[ok], b[ok]
        if len(a):
            keep = may_link(t["ranges"].take(pa.array(a)), t["ranges"].take(pa.array(b)), n[a], n[b], num, den)
            a, b = a[keep], b[keep]
        if len(a):
            swap = cls[a] > cls[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b]), pa.array(n[a].astype(np.int32)), pa.array(n[b].astype(np.int32))], ["a", "b", "n", "m"])

    def each(batches):
        held: list[pa.RecordBatch] = []

        def work(table_: pa.Table, starts: np.ndarray, ends: np.ndarray):
            t = {c: table_.column(c).to_numpy() for c in ("i", "j", "own", "cls", "root")} | {c: table_.column(c).to_numpy().astype(np.int64) for c in ("n", "pos")}
            t["ranges"] = table_.column("ranges").combine_chunks()
            sizes = ends - starts
            few = sizes <= SMALL
            for size in range(2, SMALL + 1):  # groups of one small size all at once
                at = starts[sizes == size]
                for x in range(size - 1 if len(at) else 0):
                    for y in range(x + 1, size):
                        side = (t["i"][at] == t["j"][at]) | (t["own"][at + x] != t["own"][at + y])
                        yield from made(t, at[side] + x, at[side] + y)
            for lo, hi in zip(starts[~few].tolist(), ends[~few].tolist()):
                rows_ = np.arange(lo, hi)
                own, i, j = t["own"][lo:hi], t["i"][lo], t["j"][lo]
                left, right = (rows_, rows_) if i == j else (rows_[own == i], rows_[own == j])
                for k in range(0, len(left), 256):
                    x, y = np.repeat(left[k : k + 256], len(right)), np.tile(right, len(left[k : k + 256]))
                    if i == j:
                        x, y = x[x < y], y[x < y]
                    yield from made(t, x, y)

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held).combine_chunks()
            keys = [t.column(c).to_numpy() for c in ("token", "i", "j")]
            cuts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1])
            if len(cuts) > 1:  # the last group may go on
                yield from work(t, cuts[:-1], cuts[1:])
            held = t.slice(int(cuts[-1])).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from work(t, np.array([0]), np.array([len(t)]))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "cls")
    return ordered.mapInArrow(each, "a long, b long, n int, m int").distinct()


class _Verifier:
    """Tries pairs of classes on their sets; the sets of new classes are read from the texts as they are needed."""

    def __init__(self, docs: DataFrame, profiles: DataFrame, k: int, num: int, den: int):
        self.docs, self.k, self.num, self.den = docs, k, num, den
        self.sent: list = []
        some = profiles.where("cls is not null")
        self.classes = stage(some.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("ranges").alias("ranges")), "classes")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n, m) of distinct classes that link, as (u, v)."""
        num, den = self.num, self.den
        side = lambda c: self.classes.select(F.col("cls").alias(c), F.col("ranges").alias(f"r_{c}"), F.col("doc_id").alias(f"d_{c}"))

        def likely(batches):
            for batch in batches:
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
                yield batch.select(["a", "b", "d_a", "d_b"]).filter(pa.array(may_link(batch.column(4), batch.column(5), n, m, num, den)))

        left = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n", "m", "r_a", "r_b", "d_a", "d_b")
        left = stage(left.mapInArrow(likely, "a long, b long, d_a long, d_b long"), "candidates")
        needed = left.select(F.col("a").alias("cls"), F.col("d_a").alias("doc_id")).union(left.select("b", "d_b")).distinct()
        sets = self._sets(needed)
        bs, as_ = sets.select(F.col("cls").alias("b"), F.col("s").alias("s_b")), sets.select(F.col("cls").alias("a"), F.col("s").alias("s_a"))
        both = left.select("a", "b").join(bs, "b").join(as_, "a")

        def verify(batches):
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                    at = np.searchsorted(y, x)
                    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                    good.append(den * common >= num * (len(x) + len(y) - common))
                yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

        found = both.select(F.col("a").alias("u"), F.col("b").alias("v"), "s_a", "s_b").mapInArrow(verify, "u long, v long")
        out = stage(found.distinct(), "links")
        release(sets, left)
        sent = self.sent.pop()
        sent.unpersist()
        return out

    def _sets(self, needed: DataFrame) -> DataFrame:
        """(cls, s): sets of the classes, from the text of one document of each."""
        k = self.k
        place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        word = F.shiftright(place, 5).cast("int")
        bit = F.expr(f"shiftleft(1L, cast(xxhash64(doc_id) & 31L as int))")
        words = needed.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 1 MB of bits at most
        table_ = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
        table_[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
        sent = self.docs.sparkSession.sparkContext.broadcast(table_)
        self.sent.append(sent)

        def likely(batches):
            bits = sent.value
            given: set[int] = set()  # repeated rows give a class once, as far as a task remembers
            for batch in batches:
                h = batch.column(2).to_numpy(zero_copy_only=False)
                place = h & ((1 << FILTER_BITS) - 1)
                hit = (bits[place >> 5] >> (h & 31).astype(np.uint32)) & 1
                some = batch.filter(pa.array(hit.astype(bool)))
                rows_, sets, cls = [], [], []
                for i, s in enumerate(shingle_sets(some.column(1), k)):
                    if len(s) and (c := class_of(s)) not in given:
                        if len(given) > 200_000:
                            given.clear()
                        given.add(c)
                        rows_.append(i)
                        sets.append(s.tobytes())
                        cls.append(c)
                if sets:
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows_)), pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "cls", "s"])

        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
        got = rows.mapInArrow(likely, "doc_id long, cls long, s binary")
        # the bits let some others pass, and a repeated doc_id may have several texts: only the classes asked for stay;
        # one that is given twice only makes a link twice
        want = needed.select(F.col("cls").alias("w_cls"))
        want = F.broadcast(want) if needed.count() <= BROADCAST_ROWS else want
        return stage(got.join(want, F.col("cls") == F.col("w_cls"), "left_semi").select("cls", "s"), "sets", compression="none")


def link(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; sets of k-word shingles link at num / den."""
    small_batches(docs.sparkSession)
    both = stage(_profiles(docs, k), "profiles")
    profiles = both.where("chunk is null").select("doc_id", "cls", "n", "ranges")
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(both))  # of fixed size
    rows = _prefixes(docs, k, num, den, sketch)
    headed = stage(_shared(rows), "shared")
    rows = headed.select("token", "cls", "n", "pos")
    sketch.unpersist()
    staged = [both, headed]
    verifier = _Verifier(docs, profiles, k, num, den)
    links: DataFrame | None = None
    tried: DataFrame | None = None
    roots: DataFrame | None = None
    for turn in range(star_rounds + 1):
        at = rows.withColumn("root", F.col("cls")) if roots is None else rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        if turn:  # shingles whose rows are all in one component have nothing left to find
            open_ = at.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
            at = stage(at.join(open_, "token", "left_semi"), "open")
            staged.append(at)
        one = at.select("token", F.col("cls").alias("a"), F.col("n").alias("n"), F.col("pos").alias("pos"), F.col("root").alias("root_a"))
        two = at.select("token", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("pos").alias("mpos"), F.col("root").alias("root_b"))
        if turn == star_rounds:
            pairs = _all_pairs(at, verifier.classes, num, den, BLOCK)
        else:
            if turn:
                key = F.struct(F.xxhash64("root_a", F.lit(turn)), "pos", "a")
                head = one.groupBy("token").agg(F.min(F.struct(key.alias("key"), "a", "n", "pos", "root_a")).alias("h"))
                one = head.select("token", "h.a", "h.n", "h.pos", "h.root_a")
                pairs = two.join(one, "token").where("root_a <> root_b")
            else:  # each row knows its shingle's head
                pairs = headed.select(F.col("head").alias("a"), F.col("head_n").alias("n"), F.col("head_pos").alias("pos"), F.col("cls").alias("b"), F.col("n").alias("m"), F.col("pos").alias("mpos")).where("a <> b")
            pairs = pairs.where(_possible("n", "pos", "m", "mpos", num, den))
            first = F.col("a") < F.col("b")
            turned = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(first, F.col("m")).otherwise(F.col("n")).alias("m")]
            pairs = pairs.select(*turned).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        staged.append(pairs)
        if pairs.isEmpty():
            continue
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        found = verifier.links(pairs)
        links = found if links is None else links.union(found)
        roots = stage(components(links), "roots")
        staged += [found, roots]
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node long, root long")
    named = profiles.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "cls").alias("root"))
    first = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(first, "root", "left")
    out = stage(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "linked")
    release(*staged, verifier.classes)
    return out


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those whose group has a document with a smaller doc_id; rows without an id or without words stay.

    Rows that repeat a doc_id count as one document."""
    found = link(docs, k, num, den)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct().alias("jaccard_gone")
    return docs.alias("jaccard_docs").join(gone, F.expr("cast(jaccard_docs.doc_id AS bigint) = jaccard_gone.gone"), "left_anti")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
