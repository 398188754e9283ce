import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barsmith.llm import op6_rules, op8_quality, op9_count, op10_langid

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Plain sentences and shouted ones, in two made-up languages."""
    rng = np.random.default_rng(1)
    words = {"xa": ["tolo", "mina", "paro", "seli", "kanto", "vero", "luma"], "zy": ["grish", "thwek", "snorf", "blant", "krump", "drost", "wulf"]}
    rows, labels = [], []
    for i in range(900):
        lang = "xa" if i % 3 else "zy"
        w = list(rng.choice(words[lang], rng.integers(20, 90)))
        good = i % 5 > 0
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache(), spark.createDataFrame(labels, LABELS).cache()


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    got = {r["doc_id"]: r["score"] for r in op8_quality.scores(op8_quality.feature_rows(docs), op8_quality.learn(docs, labels)).collect()}
    rows = [(i, i % 5 > 0) for i in got if held(i)]
    right = sum((got[i] >= op8_quality.THRESHOLD) == good for i, good in rows)
    assert right / len(rows) > 0.97


def test_quality_never_learns_from_held_out_labels(corpus):
    docs, labels = corpus
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (op8_quality.learn(docs, x) for x in (labels, turned))
    np.testing.assert_array_equal(a.weights, b.weights)


def moments(x):
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    return x.T @ x / len(x)


def test_nnpu_with_a_known_prior():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(1.5, 1, (500, 2)), np.concatenate([rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (300, 2))])
    w = op8_quality.fit_nnpu(moments(pos), moments(unl), 0.5)
    assert ((unl @ w[:2] + w[2] > 0) == (np.arange(600) < 300)).mean() > 0.95
    # few positives in many dimensions overfit: the estimator does not let the second term fall below zero
    pos, unl = rng.normal(0.3, 1, (12, 60)), rng.normal(0, 1, (400, 60))
    free = np.linalg.solve(moments(unl) + 1e-9 * np.eye(61), 2 * 0.9 * moments(pos)[-1] - moments(unl)[-1])
    held = op8_quality.fit_nnpu(moments(pos), moments(unl), 0.9, ridge=0.0)
    assert op8_quality.negative_risk(free, 0.9, moments(unl), moments(pos)) < 0
    risk = lambda w: 0.9 * np.mean((1 - pos @ w[:-1] - w[-1]) ** 2) + max(0, op8_quality.negative_risk(w, 0.9, moments(unl), moments(pos)))
    assert risk(held) < risk(free)


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        n = 40_000
        good = rng.random(n) < share
        h = lambda x: np.histogram(x, bins=op8_quality.BINS, range=(-4, 4))[0].astype(float)
        pos, unl = rng.normal(1, 0.5, 4000), np.where(good, rng.normal(1, 0.5, n), rng.normal(-1, 0.5, n))
        assert abs(op8_quality.best_bin_prior(h(pos), h(unl), 4000, n) - share) < 0.06
        a, b = op8_quality.calibrate(pos, h(unl), share)
        p = 1 / (1 + np.exp(-(a * unl + b)))
        assert abs(p.mean() - share) < 0.06 and ((p > 0.5) == good).mean() > 0.95


def test_sums_over_all_rows_are_those_of_numpy(corpus):
    docs, labels = corpus
    rows = docs.select("doc_id", "text").collect()
    x = op8_quality.features(pa.array([r["text"] for r in rows]))
    free = np.array([not held(r["doc_id"]) for r in rows])
    m = op8_quality.learn(docs, labels)
    np.testing.assert_allclose(m.mean, x[free].astype(float).mean(axis=0), rtol=1e-4, atol=1e-6)
    np.testing.assert_allclose(m.spread, np.maximum(x[free].astype(float).std(axis=0), 1e-3), rtol=1e-3, atol=1e-5)


def auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_query_8_on_held_out_labels(spark, sf):
    """The whole query: scores follow from the model by hand, and rank held-out labels."""
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in op8_quality.op8_quality(spark, big).collect()}
    assert len(got) == docs.count()
    m = op8_quality.learn(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    want = 1 / (1 + np.exp(-(m.slope * np.clip(m.raw(op8_quality.features(pa.array([r["text"] for r in rows]))).astype(float), -4, 4) + m.shift)))
    np.testing.assert_allclose([got[r["doc_id"]]["score"] for r in rows], want, atol=1e-5)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(i) for i, r in got.items())
    known = [(got[r["doc_id"]]["score"], r["quality"] == 1) for r in labels.where("quality is not null").collect() if held(r["doc_id"]) and r["doc_id"] in got]
    s, good = (np.array(x) for x in zip(*known))
    assert auc(s, good) > 0.95


def test_quality_of_odd_rows(odd, wide, empty, corpus):
    docs, labels = corpus
    model = op8_quality.learn(docs, labels)
    for rows in (odd, wide):
        got = op8_quality.scores(op8_quality.feature_rows(rows), model).collect()
        assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op8_quality.scores(op8_quality.feature_rows(empty), model).count() == 0
    assert op8_quality.learn(empty, labels) is None and op8_quality.learn(docs, labels.limit(0)) is None
    assert {r["score"] for r in op8_quality.scores(op8_quality.feature_rows(odd), None).collect()} == {1.0}
    kept = op8_quality.keep_good(wide, model)
    assert kept.columns == wide.columns
    positives = op8_quality.learn(docs, labels.where("quality = 1"))
    assert 0.01 <= positives.prior <= 0.99


def test_language_on_held_out_rows(corpus):
    docs, _ = corpus
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op10_langid.predict(docs, op10_langid.fit(docs)).collect()}
    assert all(got[i][0] == ("xa" if i % 3 else "zy") for i in got if held(i))
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_by_hand():
    s = lambda *v: np.array(v, dtype=np.float32)
    known = [{"la": s(1, 3)}, {"q": s(5, 2)}, {" z": s(2, 4)}, {}, {}, {}]
    m = op10_langid.Model(["a", "b"], known)
    names, sure = m.predict(pa.array(["la la", "q", "zz", "", None, "12 !", "ww", "LA q"]))
    assert names == ["a", "b", "a", "und", "und", "und", "a", "b"]
    assert sure[3] == 0 and abs(sure[6] - 0.5) < 1e-6  # nothing known: a tie, the first name
    assert math.isclose(sure[0], 1 / (1 + 10 ** (-2 * 2)), rel_tol=1e-5)


def test_language_of_odd_rows(odd, wide, empty):
    model = op10_langid.fit(odd.select("doc_id", "lang", "text"))
    for rows in (odd, wide):
        got = op10_langid.predict(rows, model).collect()
        assert len(got) == rows.count()
        assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (3, 4, 5, 9))
    nothing = op10_langid.fit(empty)
    assert op10_langid.predict(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in op10_langid.predict(odd, nothing).collect()} == {"und"}
    assert op10_langid.keep_identified(wide, model).columns == wide.columns


def test_counts_equal_the_library():
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    v = op9_count.vocabulary(op9_count.default_path())
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in v)), *v], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace("▁", "always", True)])
    texts = ["the cat sat", "", "  ", "中文字 ①①x ①", "internationalisation of things\n\tof\x0bz", "ééé ñandú 12345", "a" * 3000, "▁ ▁▁a"]
    _, got = op9_count.count_texts(pa.array([*texts, None]), op9_count.default_path())
    assert got.tolist() == [len(t.encode(x).ids) for x in texts] + [0]


def test_viterbi_against_all_segmentations():
    pieces = [("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.5), ("aba", -3.5), ("▁a", -2.9)]
    c = op9_count.Counter(pieces)
    scores = dict(pieces)

    def best(text):  # earliest start of equals at every end, as the tokenizer's own tie rule has it
        ends = {0: (0.0, 0)}
        for e in range(1, len(text) + 1):
            for s in range(e):
                if text[s:e] in scores:
                    x = scores[text[s:e]] + ends[s][0]
                    if e not in ends or x > ends[e][0]:
                        ends[e] = (x, ends[s][1] + 1)
        return ends[len(text)][1]

    for n in range(1, 64):
        text = "▁" + bin(n)[2:].replace("0", "a").replace("1", "b")
        assert c.count(text) == best(text)
    assert c.count("▁xyz") == 2 and c.count("▁axxb") == 3


def test_counts_of_odd_rows(odd, wide, empty):
    for rows in (odd, wide):
        got = op9_count.token_counts(rows).collect()
        assert len(got) == rows.count() and all((r["n_tokens"] == 0) == (r["n_words"] == 0) for r in got)
    assert op9_count.token_counts(empty).count() == 0


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    w = WORDS.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(odd, wide, empty):
    texts = ["a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "é#中 **", "", "a b", "a b c d", "p q r s p q r t\np q r"]
    got = op6_rules.measure(pa.array([*texts, None]))
    for i, t in enumerate([*texts, ""]):
        assert tuple(int(got[c][i]) for c in op6_rules.COLUMNS[:5]) == by_hand(t), t
    for rows in (odd, wide.drop("stratum")):
        assert op6_rules.statistics(rows).count() == rows.count()
    assert op6_rules.statistics(empty).count() == 0


def test_binomial_bounds():
    for k, n in ((0, 30), (2, 50), (7, 7)):
        u = op6_rules.upper_bound(k, n, 0.05)
        assert u == 1.0 if k == n else abs(op6_rules.tail_at_most(k, n, u) - 0.05) < 1e-9
    assert abs(op6_rules.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert abs(op6_rules.tail_at_most(2, 5, 0.5) - 0.5) < 1e-12


def test_cutoffs_spare_good_documents(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(6000):
        lang, good = "ab"[i % 2], i % 4 > 0
        words = [str(x) for x in rng.integers(0, 10**6, 60)]
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, LABELS)
    stats = op6_rules.statistics(docs)
    cuts = op6_rules.choose(stats, labels, alpha=0.05)
    assert {r["stratum"] for r in cuts.collect()} == {"a", "b"} and all(r["bound"] <= 0.05 for r in cuts.collect())
    out = op6_rules.judge(stats, cuts).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    kept = {r[0]: r[1] for r in out}
    assert kept[1] >= 0.95 and kept[0] < 0.05
    # few labels show nothing, so nothing goes
    few = op6_rules.choose(stats, labels.limit(50))
    assert few.count() == 0 and op6_rules.judge(stats, few).where("not kept and not base_failed").count() == 0
