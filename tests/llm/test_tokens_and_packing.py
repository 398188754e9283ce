import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barsmith.llm import op2_rans, op3_packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.encoder(tokens.default_path()).tokenizer


def plain(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbc .,!?'’\n\t 1éİΣσ中①́<|>-_")), max_size=40), max_size=6))
def test_ids_equal_the_library(texts):
    import pyarrow as pa

    t = tokens.encoder(tokens.default_path()).tokenizer
    got = []
    for _, ids, bounds in tokens.encode_texts(pa.array(texts, pa.string()), tokens.default_path(), 2):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [plain(t, x, 2).tolist() for x in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=3000), st.integers(1, 5))
def test_round_trip(ids, times):
    ids = np.array(ids * times, dtype=np.int64)
    freq = op2_rans.quantise(np.bincount(ids, minlength=501)).tobytes()
    c = op2_rans.coder(freq)
    assert [i for part in op2_rans.pack_blocks(ids, freq) for i in c.decode(part).tolist()] == ids.tolist()


def test_parts_and_checksums():
    ids = np.random.default_rng(0).zipf(1.4, 400_000) % 3000
    freq = op2_rans.quantise(np.bincount(ids, minlength=3000)).tobytes()
    c = op2_rans.coder(freq)
    lanes = op2_rans.MAX_LANES
    old, op2_rans.CHECKPOINT_STEPS = op2_rans.CHECKPOINT_STEPS, 16
    try:
        parts = c.encode(ids[:300_000])
    finally:
        op2_rans.CHECKPOINT_STEPS = old
    assert len(parts) == -(-300_000 // (16 * lanes)) > 3
    # every part decodes by itself, in any order
    got = [c.decode(p).tolist() for p in reversed(parts)][::-1]
    assert [i for p in got for i in p] == ids[:300_000].tolist() and len(got[0]) == 16 * lanes
    for k in (0, 2, len(parts) - 1):
        for at in (op2_rans.HEAD.size + 1, -1):
            broken = bytearray(parts[k])
            broken[at] ^= 1
            with pytest.raises(ValueError):
                c.decode(bytes(broken))
    with pytest.raises(ValueError):
        c.decode(struct.pack("<4s", b"none") + parts[0][4:])


def test_quantised_frequencies():
    for counts in (np.array([1]), np.array([0, 5, 0, 10**9]), np.ones(60_000, dtype=np.int64), np.minimum(np.random.default_rng(1).zipf(1.2, 50_000), 10**9)):
        f = op2_rans.quantise(counts)
        assert f.sum() == 1 << op2_rans.SCALE and ((f > 0) == (counts > 0)).all()
    with pytest.raises(ValueError):
        op2_rans.quantise(np.ones(5000, dtype=np.int64), 12)


def test_written_ids(spark, odd, wide, empty, tokenizer):
    for docs in (odd, wide):
        written, freq = op2_rans.write_ids(docs, end_id=2, partitions=3)
        got = op2_rans.read_ids(written, freq).orderBy("start").collect()
        keys = [r["doc_id"] for r in got]
        assert keys == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        at = 0
        for r in got:
            want = plain(tokenizer, texts[r["doc_id"]], 2)
            assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(want), want.tobytes())
            at += len(want)
        # parts dealt to other tasks hold the same ids
        parts = op2_rans.read_parts(written.repartition(4), freq).orderBy("shard", "container", "part").collect()
        assert b"".join(bytes(p["ids"]) for p in parts) == b"".join(bytes(r["ids"]) for r in got)
    written, freq = op2_rans.write_ids(empty, partitions=2)
    assert op2_rans.read_ids(written, freq).count() == 0


def test_documents_over_many_parts(spark, tokenizer, monkeypatch):
    """Documents that span checkpoints and blocks, several containers a task."""
    for name, value in (("BLOCK_IDS", 700), ("CONTAINER_IDS", 1500), ("CHECKPOINT_STEPS", 4), ("MAX_LANES", 16)):
        monkeypatch.setattr(op2_rans, name, value)
    texts = ["the cat sat on the mat " * k for k in (1, 300, 2, 0, 90, 40, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenised = [plain(tokenizer, t, 2) for t in texts]
    freq = op2_rans.quantise(np.bincount(np.concatenate(tokenised))).tobytes()
    rows, first = [], 0
    for lo, hi in ((0, 2), (2, 7)):
        ids = np.concatenate(tokenised[lo:hi]).astype(np.int64)
        rows.append((0, lo, first, len(ids), list(range(lo, hi)), [len(x) for x in tokenised[lo:hi]], op2_rans.pack_blocks(ids, freq)))
        first += len(ids)
    written = spark.createDataFrame(rows, op2_rans.CONTAINER).coalesce(1)
    assert len(rows[0][-1]) > 8
    got = op2_rans.read_ids(written, freq).orderBy("start").collect()
    assert [bytes(r["ids"]) for r in got] == [x.astype("<u4").tobytes() for x in tokenised]


def test_query_2(spark, sf, tokenizer):
    got = {r["doc_id"]: r for r in op2_rans.op2_rans(spark, sf).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = plain(tokenizer, r["text"], 2)
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def check_packing(rows, size):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length >= 1
            at += length
        assert at <= size
    return len(seqs)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30, 400)
    where, offset = op3_packing.sum_of_squares(lengths, 30)
    # brute force: the sum of squares itself, for every choice
    gaps = {}
    for s, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        def total(choice):
            after = dict(gaps)
            after[choice] = after.get(choice, 30) - s
            n = {}
            for g in after.values():
                if g:
                    n[g] = n.get(g, 0) + 1
            return sum(v * v for v in n.values())

        choices = [b for b, g in gaps.items() if g >= s] + ["new"]
        best = min(map(total, choices))
        assert total(w if w in gaps else "new") == best
        assert o == 30 - gaps.get(w, 30)
        gaps[w] = gaps.get(w, 30) - s


def test_packed_pieces(spark, odd, wide, empty, tokenizer):
    for docs in (odd, wide):
        got = op3_packing.pack(op3_packing.pieces(docs, max_ids=64, with_ids=True), 64).collect()
        check_packing(got, 64)
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        whole = sum(len(plain(tokenizer, t, 1)) for _, t in texts)
        assert sum(r["length"] for r in got) == whole
        one = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == 6)
        assert b"".join(b for _, b in one) == plain(tokenizer, dict(texts)[6], 1).tobytes()
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    assert op3_packing.pack(op3_packing.pieces(empty)).count() == 0


def test_equal_rows_and_clashing_columns(spark):
    """A third of all rows alike, with no id: each has a place of its own, and groups stay even."""
    rows = [(None, 0, 10, "x", "y")] * 300 + [(i, 0, 1 + i % 40, "x", "y") for i in range(600)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string, offset string")
    got = op3_packing.pack(items, 40, group_pieces=100)
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert check_packing(got.collect(), 40) < 1.1 * sum(r[2] for r in rows) / 40 + 9
    sizes = [r["n"] for r in got.groupBy((got["sequence_id"] / 2**40).cast("long").alias("g")).agg({"length": "count"}).toDF("g", "n").collect()]
    assert len(sizes) == 9 and max(sizes) <= 140


def test_sequences_hold_their_pieces(odd):
    packed = op3_packing.pack(op3_packing.pieces(odd, max_ids=64, with_ids=True), 64)
    made = {r["sequence_id"]: bytes(r["ids"]) for r in op3_packing.sequences(packed).collect()}
    for r in packed.collect():
        assert made[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_query_3(spark, sf, tokenizer):
    rows = op3_packing.op3_packing(spark, sf).collect()
    n = check_packing(rows, 4096)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, own = plain(tokenizer, d["text"], 1), sorted(pieces.pop(d["doc_id"]), key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert not pieces
    assert n <= -(-sum(r["length"] for r in rows) // 4096) * 1.05 + 1


def test_no_collection_while_chunks_are_encoded():
    """Ids of many new chunks come without a pass of the collector of cycles, and are the library's own."""
    import gc

    from barsmith.llm import tokens as t

    enc, runs = t.ChunkEncoder(t.default_path()), []
    chunks = [f"{'Ab' if i % 3 else 'ab'}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'.,!'[: i % 4]}" for i in range(3000)]
    watch = lambda phase, info: runs.append(phase)
    gc.callbacks.append(watch)
    try:
        got = enc.ids(chunks)
        during = len(runs)
    finally:
        gc.callbacks.remove(watch)
    assert during == 0 and gc.isenabled()
    want = enc.tokenizer.encode_batch(chunks[:200], add_special_tokens=False)
    assert [list(memoryview(g).cast("I")) for g in got[:200]] == [w.ids for w in want]


def test_capitals_and_marks_as_the_library(tokenizer):
    """Capitals of special tokens and below marks that only small letters join; letters of all kinds before the marks of clauses."""
    import pyarrow as pa

    texts = ["<|ENDOFTEXT|> a<|EndOfText|>b <|endoftext|>. A", "H̱. T̈ W̊, Y̊ J̌: İ! Á", "İ. İ! ŉ. Dž, ǅ; ª. ß: ẞ? ΑΣ. K. Å, é.é ×. ÷, क़.", "'S. it'S, É'Ll: 1.2.3,4 É.́a ½. Ⅷ, ۳."]
    texts += [" ".join(f"{c}. {c}A, A{c}! H{c}.{c}" for c in map(chr, range(lo, lo + 64))) for lo in range(0x80, 0x600, 64)]
    got = []
    for _, ids, bounds in tokens.encode_texts(pa.array([*texts, None]), tokens.default_path(), 2):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [plain(tokenizer, t, 2).tolist() for t in [*texts, None]]


def test_words_meet_the_library_once(monkeypatch):
    """Accented words reach the library in joint calls and once each, whatever mark follows them."""
    import pyarrow as pa

    class Counted:
        def __init__(self, inner):
            self.inner, self.given = inner, []

        def encode_batch_fast(self, texts, **options):
            self.given += texts
            return self.inner.encode_batch_fast(texts, **options)

    enc = tokens.encoder(tokens.default_path())
    seen = Counted(enc.tokenizer)
    monkeypatch.setattr(enc, "tokenizer", seen)
    words = [f"éqx{chr(97 + i % 26)}{chr(97 + i // 26)}ñ" for i in range(400)]
    texts = [f"{w} {w}, {w}. {w}! {w};" for w in words]
    got = []
    for _, ids, bounds in tokens.encode_texts(pa.array(texts), tokens.default_path(), 2):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [plain(seen.inner, t, 2).tolist() for t in texts]
    parts = [p for t in seen.given for p in t.split(" ")]
    assert len(seen.given) <= 20 and sum(w in parts for w in words) == 400 and len(parts) <= 420
