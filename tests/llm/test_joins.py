import numpy as np
import pyarrow as pa
import pytest

from barsmith.llm import op5_jaccard, op7_neighbours
from barsmith.llm.components import components


def brute_components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = np.random.default_rng(0)
    cases = [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(60)], [(5, 5)], []]
    for edges in cases:
        df = spark.createDataFrame(edges, "u long, v long") if edges else spark.createDataFrame([], "u long, v long")
        got = {r["node"]: r["root"] for r in components(df).collect()}
        assert got == brute_components([(a, b) for a, b in edges if a != b])


def brute_links(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    edges = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = brute_components(edges)
    return {i: (len(sets[i]), root.get(i, i)) for i in ids}


def near_copies(n, seed):
    """Groups of near copies, chains of slow change, passages shared by otherwise different texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 400)
    shared = [word() for _ in range(30)]
    texts, chain = [], [word() for _ in range(60)]
    base = [word() for _ in range(70)]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = word()
        elif kind == 1:
            chain[rng.integers(0, len(chain))] = word()
            w = list(chain)
        elif kind == 2:
            w = shared + [word() for _ in range(rng.integers(0, 40))]
        else:
            w = [word() for _ in range(rng.integers(0, 8))]
        texts.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return texts


@pytest.mark.parametrize("k,num,den,rounds", [(4, 85, 100, 2), (5, 80, 100, 1), (3, 60, 100, 0)])
def test_join_against_brute_force(spark, k, num, den, rounds):
    texts = near_copies(120, k)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_jaccard.link(docs, k, num, den, rounds).collect()}
    assert got == brute_links(texts, k, num, den)


def test_blocks_of_a_hot_shingle(spark, monkeypatch):
    """Groups larger than a block are paired block by block."""
    monkeypatch.setattr(op5_jaccard, "BLOCK", 8)
    texts = near_copies(100, 9)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_jaccard.link(docs, 4, 85, 100, 0).collect()}
    assert got == brute_links(texts, 4, 85, 100)


def test_suffix_filter_never_drops_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique((rng.integers(0, 2**63, rng.integers(1, 1600)) * 2).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], (rng.integers(0, 2**63, rng.integers(0, 9)) * 2).astype(np.uint64)]))
        if len(b):
            common = len(np.intersect1d(a, b))
            link = 100 * common >= 85 * (len(a) + len(b) - common)
            may = op5_jaccard.may_link(pa.array([op5_jaccard.ranges(a)]), pa.array([op5_jaccard.ranges(b)]), np.array([len(a)]), np.array([len(b)]), 85, 100)
            assert may[0] or not link


def test_odd_documents(odd, wide, empty):
    for docs in (odd, wide):
        got = op5_jaccard.link(docs).collect()
        by = {r["doc_id"]: r["component_id"] for r in got}
        assert len(got) == docs.count()
        assert by[1] == by[2] == 1 and by[7] == by[8] == 7
        assert all(by[i] == i for i in (3, 4, 5, 6, 9, 10)) and by[None] is None
        assert {r["doc_id"]: r["n_shingles"] for r in got}[3] == 0
        kept = op5_jaccard.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 9, 10]
    assert op5_jaccard.link(empty).count() == 0


def brute_neighbours(rows, asked, k):
    out = {}
    for q, x in rows:
        if asked(q):
            found = sorted(((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in rows if i != q))[:k]
            out[q] = [i for _, i in found]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(60)]  # one very common vector
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, []), (None, [1.0] * 16), (9005, [float("inf")] + [0.0] * 15)]
    rows.append((9010, [1.0] * 3 + [0.0] * 13))
    short = [(9010, [1.0] * 3), (9010, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows[:-1] + short + bad], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in op7_neighbours.search(df, lambda i: i % 20 == 0, leaf=128).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_neighbours(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & set(want[q])) / 20 for q in want])
    assert recall >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        for i, s in found[:3]:
            assert abs(s - float(np.dot(np.float64(vectors[q]), np.float64(vectors[i])))) < 1e-12


def test_vectors_of_doubles(spark):
    """Doubles are searched as doubles: scores hold their last digits, and what no float holds takes part."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-50, 50)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors, asked = dict(rows), lambda i: i % 20 == 0
    got = op7_neighbours.search(df, asked, leaf=1000).collect()
    assert {r["query_id"] for r in got} == {i for i in vectors if i % 20 == 0}
    for r in got:
        a, b = (np.array(vectors[r[c]]) for c in ("query_id", "vec_id"))
        assert abs(r["score"] - a @ b) <= 1e-12 * np.abs(a * b).sum()
    want = brute_neighbours(rows, asked, 1)
    assert {r["query_id"]: [r["vec_id"]] for r in got if r["rank"] == 1} == want


def test_few_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op7_neighbours.search(df, lambda i: i % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert op7_neighbours.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_chi_square_quantiles():
    assert abs(op7_neighbours.chi_square_quantile(0.95, 8) - 15.50731) < 1e-4
    assert abs(op7_neighbours.chi_square_quantile(0.5, 2) - 1.386294) < 1e-5


def test_pipeline_runs_and_stages_keep_their_columns(spark, sf):
    import corpus_pipeline
    from barsmith.llm.common import stage

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = stage(f(spark, docs, sf), name)
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[2] <= sizes[1] <= sizes[0] <= 200 and sizes[2] > 100
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
