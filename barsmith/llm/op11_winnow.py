"""Document fingerprints by winnowing.

A text's k-grams of code points get polynomial hashes; of every W hashes in a row the
smallest is kept, of equal ones the rightmost, with its place in the text.  So any
run of K + W - 1 code points that two texts share gives both a common hash (``spans``
finds it by the places), and nothing shorter than K ever does.  A text with fewer
grams than W keeps the smallest of them, one shorter than K is a single gram.

The query holds every document against an edited copy, whose last quarter is the
beginning of the next document by doc_id, and against that next document.  Documents
are dealt to ranges of (doc_id, hash of the text) whose borders come from a sample of
keys, as for a distributed sort; the first document of a range also goes to the
range before as its look-ahead, the very first one to the last range.  So each task
reads one sorted stream and holds one document and its successor, and texts move once.

Likeness is the Jaccard coefficient of the sets of kept hashes, 1 for two empty ones.

Edge cases: null texts count as empty, empty texts have an empty fingerprint; rows
without a doc_id come first, rows of one doc_id are ordered by their text's hash, equal
rows follow each other in any order; a lone document is its own next one; very
long texts are read whole, and one whose hashes fall steadily (or a single repeated
character) keeps a hash at every place; tables without rows give none; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Code points of a gram, and grams of a window.
K, W = 12, 32
#: Characters of text of one range, as long as the session's partitions are not smaller; keys that are sampled for a range and at most.
RANGE_CHARS, KEYS_A_RANGE, MOST_KEYS = 128 << 20, 50, 1_000_000
#: An odd number, and the finalizer of splitmix64.
BASE, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """Hashes of the k-grams of a text's code points (of the whole text if it is shorter), each from two halves."""
    one = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(BASE))
    if not len(one):
        return one
    k = min(k, len(one))
    h, size, power = one, 1, BASE
    for bit in f"{k:b}"[1:]:
        h, size, power = h[:-size] * np.uint64(power) + h[size:], 2 * size, power * power & _ALL
        if bit == "1":
            h, size, power = h[:-1] * np.uint64(BASE) + one[size:], size + 1, power * BASE & _ALL
    return _mix(h)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) that a text keeps, by place."""
    grams = gram_hashes(text, k)
    w = min(w, len(grams))
    best, at, size = grams, np.arange(len(grams), dtype=np.int64), 1
    while size < w:
        step = min(size, w - size)
        later = best[step:] <= best[:-step]
        best, at, size = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step]), size + step
    places = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return grams[places], places


def encode(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as text: base64 of its hashes, 8 bytes each, and its places, 4 bytes each."""
    return ".".join(b64encode(v.astype(kind).tobytes()).decode() for v, kind in ((hashes, ">u8"), (places, ">u4"))) if len(hashes) else ""


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, places = fingerprint.partition(".")
    return np.frombuffer(b64decode(hashes), ">u8").astype(np.uint64), np.frombuffer(b64decode(places), ">u4").astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sets of hashes (each once)."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def spans(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the hashes that two fingerprints share: each the last place of that hash in its text."""
    last = dict(zip(a[0].tolist(), a[1].tolist()))
    other = dict(zip(b[0].tolist(), b[1].tolist()))
    return sorted((i, other[h]) for h, i in last.items() if h in other)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hash, place): every kept hash of every document, for joins of fingerprints over a corpus."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches):
        for b in batches:
            kept = [winnow(t or "", k, w) for t in b.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(kept)), [len(h) for h, _ in kept])
            hashes, places = (np.concatenate([x[i] for x in kept]) if kept else np.empty(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(hashes.astype(np.uint64).view(np.int64)), pa.array(places.astype(np.int32))], ["doc_id", "hash", "place"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, hash long, place int")


_FIRST = -(1 << 63)


def _keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(id, hash) pairs as texts of 16 bytes, in their order."""
    both = np.empty((len(ids), 2), ">u8")
    both[:, 0] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = hashes.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.view("S16").ravel()


def in_order(docs: DataFrame) -> DataFrame:
    """(range, ahead, id, hash, doc_id, text): documents dealt to ranges by (doc_id, hash of the text), each range sorted
    and closed by a look-ahead, the document that follows its last one.

    The driver holds KEYS_A_RANGE keys and one first key a range: some hundred bytes for each 128 million characters."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), "doc_id").withColumn("hash", F.xxhash64("text"))
    size = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["chars"] // RANGE_CHARS))
    share = min(1.0, min(KEYS_A_RANGE * parts, MOST_KEYS) / max(size["n"], 1))
    chosen = keyed.where(F.pmod(F.xxhash64("id", "hash"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "hash").toPandas()
    sample = np.sort(_keys(chosen["id"].to_numpy(), chosen["hash"].to_numpy()))
    borders = np.unique(sample[(np.arange(1, parts) * len(sample)) // parts]) if len(sample) else sample

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, _keys(ids.to_numpy(), hashes.to_numpy()), side="right").astype(np.int32))

    heads = keyed.select(range_of("id", "hash").alias("range"), "id", "hash").groupBy("range").agg(F.min(F.struct("id", "hash")).alias("head")).orderBy("range").collect()
    used = np.array([r["range"] for r in heads], np.int32)
    first = _keys(np.array([r["head"]["id"] for r in heads], np.int64), np.array([r["head"]["hash"] for r in heads], np.int64))

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """A document's range, and after it the one whose look-ahead it is."""
        keys = _keys(ids.to_numpy(), hashes.to_numpy())
        own = np.searchsorted(borders, keys, side="right")
        at = np.searchsorted(used, own)
        return pd.Series([[int(r), int(used[i - 1])] if head else [int(r)] for r, i, head in zip(own, at, first[at] == keys)])

    dealt = keyed.select("id", "hash", "doc_id", "text", F.posexplode(places("id", "hash")).alias("ahead", "range"))
    return dealt.select("range", "ahead", "id", "hash", "doc_id", "text").repartitionById(len(borders) + 1, F.col("range")).sortWithinPartitions("range", "ahead", "id", "hash")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Every document's fingerprint, its edited copy's, and their likeness to it and to the next document's."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def each(batches):
        held = None  # the document before: range, doc_id, text, hashes, places, distinct hashes
        for b in batches:
            out: list[tuple] = []
            for part, ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))):
                if ahead and held is None:
                    continue  # rows that are equal to the look-ahead
                hashes, places = winnow(text, k, w)
                distinct = np.unique(hashes)
                if held is not None:
                    _, own, was, h, p, d = held
                    copy = edited(was, text)
                    eh, ep = winnow(copy, k, w)
                    out.append((own, len(was), hashlib.sha256(copy.encode("utf-8", "surrogatepass")).hexdigest(), encode(h, p), encode(eh, ep), likeness(d, np.unique(eh)), likeness(d, distinct)))
                held = None if ahead else (part, doc_id, text, hashes, places, distinct)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (b.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))], list(names))

    ordered = in_order(docs).select("range", "ahead", "doc_id", "text")
    return ordered.mapInArrow(each, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op11_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited copies, and how near they are to those and to their successors."""
    return compare(table(spark, sf_dir, "documents"))
