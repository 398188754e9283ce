"""The registered queries and the pipeline over whole small tables, against plain Python."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barsmith.llm import op5_jaccard, op6_rules, op7_neighbours, op9_count, op10_langid
from barsmith.llm.common import stage

from .test_joins import brute_links, brute_neighbours
from .test_learned import by_hand, held
from .test_urls_and_mixing import names_inside


def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_query_5(spark, sf):
    texts = [(i, r["text"]) for i, r in documents(spark, sf).items()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_jaccard.op5_jaccard(spark, sf).collect()}
    assert got == brute_links(texts, 4, 85, 100)


def test_query_6(spark, sf):
    """Statistics by hand, cutoffs and verdicts by the rules written out anew."""
    big = sf.replace("sf0.001", "sf0.01")
    docs = documents(spark, big)
    got = {r["doc_id"]: r for r in op6_rules.op6_rules(spark, big).collect()}
    assert set(got) == set(docs)
    good = {r["doc_id"] for r in spark.read.parquet(f"{big}/labels.parquet").where("quality = 1").collect()}
    tune = {r["doc_id"]: r["t"] for r in spark.createDataFrame([(i,) for i in docs], "doc_id long").select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)) == 0).alias("t")).collect()}
    rows = {}
    for i, r in docs.items():
        text = r["text"] or ""
        n, chars, symbols, dup, rep = by_hand(text)
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        failed = n < 50 or 100 * rep > 50 * n
        assert g["base_failed"] == failed
        lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in text.split("\n"))
        w = max(n, 1)
        rows[i] = (r["lang"], failed, (symbols / w, dup / max(lines, 1), rep / w, sum("A" <= c <= "Z" for c in text) / max(chars, 1), sum(c in "!?" for c in text) / w, chars / w, -chars / w))
    strata = {lang for lang, failed, _ in rows.values()}
    known = {s: [i for i, (lang, failed, _) in rows.items() if lang == s and not failed and i in good] for s in strata}
    tuned = {s: [rows[i][2] for i in ids if tune[i]] for s, ids in known.items()}
    cut = {}
    for s in (s for s in strata if tuned[s]):
        held_ = [rows[i][2] for i in known[s] if not tune[i]]
        for share in op6_rules.LADDER:
            q = [sorted(v)[max(1, math.ceil((1 - op6_rules.ALPHA * share / 7) * len(v) - 1e-9)) - 1] for v in zip(*tuned[s])]
            hits = sum(any(a > b for a, b in zip(v, q)) for v in held_)
            if op6_rules.upper_bound(hits, len(held_), op6_rules.DELTA / sum(bool(x) for x in tuned.values())) > op6_rules.ALPHA:
                break
            cut[s] = q
    for i, (lang, failed, v) in rows.items():
        assert got[i]["kept"] == (not failed and not (lang in cut and any(a > b for a, b in zip(v, cut[lang]))))


def test_query_7(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    sound = [(i, v) for i, v in rows if v is not None and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    got = {}
    for r in op7_neighbours.op7_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_neighbours(sound, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.97


def test_visits_follow_the_queries(spark):
    """A leaf is copied as often as its own visits need, so work grows with visits, not with queries times leaves."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 8)) * 4
    x = centres[np.arange(4000) % 8] + 0.1 * rng.normal(size=(4000, 8))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    seen = []
    old = op7_neighbours.stage
    try:
        op7_neighbours.stage = lambda d, tag, *a, **k: (lambda out: (seen.append((tag, out.count())) if tag == "visits" else None, out)[1])(old(d, tag, *a, **k))
        assert op7_neighbours.search(df, lambda i: i % 20 == 0, leaf=64).count() == 4000
    finally:
        op7_neighbours.stage = old
    leaves, asked = 64, 200
    assert 2 <= len(seen) <= 4 and seen[0][1] == op7_neighbours.FIRST_LEAVES * asked
    assert sum(n for _, n in seen) < 0.6 * leaves * asked


def test_query_9(spark, sf):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    v = op9_count.vocabulary(op9_count.default_path())
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in v)), *v], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace("▁", "always", True)])
    docs = documents(spark, sf)
    for r in op9_count.op9_count(spark, sf).collect():
        assert r["n_tokens"] == len(t.encode(docs[r["doc_id"]]["text"] or "").ids)


def test_query_10(spark, sf):
    """Every prediction by plain Python from the model's tables, and accuracy on rows that it has not seen."""
    big = sf.replace("sf0.001", "sf0.01")
    docs = documents(spark, big)
    model = op10_langid.fit(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang", "text"))
    right = []
    for r in op10_langid.op10_langid(spark, big).collect():
        d = docs[r["doc_id"]]
        words = "".join(c if c.isalpha() else " " for c in (d["text"] or "").lower()).split()
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = np.zeros(len(model.langs))
        for w in words:
            row = model.known[0].get(w)
            for n in range(min(op10_langid.LONGEST, len(w) + 2), 0, -1):
                if row is None:
                    hits = [model.known[n][g] for g in op10_langid.grams(w, n) if g in model.known[n]]
                    row = sum(hits) / len(hits) if hits else None
            total += np.full(len(total), op10_langid.PENALTY) if row is None else row
        mean = total / len(words)
        odds = np.exp(-math.log(10) * (mean - mean.min()) * min(len(words), op10_langid.SURE_WORDS))
        assert r["lang_pred"] == model.langs[int(np.argmin(mean))] and abs(r["score"] - 1 / odds.sum()) < 1e-4
        assert r["held_out"] == held(r["doc_id"])
        if r["held_out"] and d["lang"] is not None:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 100 and np.mean(right) > 0.97


def test_number_signs_are_no_letters(spark):
    model = op10_langid.Model(["a"], [{"x": np.zeros(1, np.float32)}, {}, {}, {}, {}, {}])
    df = spark.createDataFrame([(1, "① ½ ²"), (2, "Ⅷ 12 !"), (3, "É①é"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in op10_langid.predict(df, model).collect()} == {1: "und", 2: "und", 3: "a", 4: "und"}


def test_pipeline_by_hand(spark, sf):
    """Each stage's rows from its predecessor's, by the operators' own results on the driver."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, f in corpus_pipeline.STAGES:
        kept.append(stage(f(spark, kept[-1], sf), name))
    quality, language, apart, mixed, packed = kept[1:]
    words = lambda rows: {r["doc_id"]: r for r in rows}
    before, after = words(language.collect()), words(apart.collect())
    groups = brute_links([(i, r["text"]) for i, r in before.items()], 5, 80, 100)
    assert set(after) == {i for i, (_, c) in groups.items() if c == i}
    assert {r["doc_id"] for r in quality.collect()} <= {r["doc_id"] for r in docs.collect()}
    times = {}
    for r in mixed.collect():
        assert r["text"] == after[r["doc_id"]]["text"]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    lengths = {}
    for r in packed.collect():
        if r["piece"] == 0:
            lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + 1
    assert lengths == times


@pytest.mark.parametrize("kind", ["odd", "wide", "empty"])
def test_pipeline_of_odd_tables(spark, sf, odd, empty, kind):
    docs = {"odd": odd, "empty": empty, "wide": odd.select("*", *(F.lit("clash").alias(n) for n in names_inside()))}[kind]
    columns = docs.columns
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = stage(f(spark, docs, sf), name)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    got = docs.collect()
    assert (kind == "empty") == (not got) or kind != "empty"
    assert all(r["length"] >= 1 for r in got) and zlib.crc32(b"") == 0
