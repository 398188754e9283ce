import datetime as dt

import pandas as pd
import pytest

from barsmith.llm import op1_urls, op4_mixing

duckdb = pytest.importorskip("duckdb")


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


LOG = [
    ("domain", "bad.com", "block", at(10)),
    ("domain", "bad.com", "lift", at(20)),
    ("domain", "bad.com", "block", at(400)),
    ("prefix", "bad.com/good", "allow", at(0)),
    ("prefix", "ok.org/a/b", "block", at(5)),
    ("url", "ok.org/a/b/c.html", "allow", at(6)),
    ("domain", None, "block", at(1)),
    ("nonsense", "x.y", "block", at(1)),
]
CASES = [
    ("http://bad.com/x", at(9), "allow", None),
    ("http://bad.com/x", at(10), "block", "d:bad.com"),
    ("https://u@www.BAD.com.:80/x?q#f", at(19, 23), "block", "d:bad.com"),
    ("http://bad.com/x", at(20), "allow", None),
    ("http://bad.com/x", at(500), "block", "d:bad.com"),
    ("http://bad.com/good/y", at(12), "allow", "p:bad.com/good"),
    ("http://bad.com/goodness", at(12), "block", "d:bad.com"),
    ("http://notbad.com/", at(12), "allow", None),
    ("http://ok.org/a/b/d", at(7), "block", "p:ok.org/a/b"),
    ("http://ok.org/a/b/c.html", at(7), "allow", "u:ok.org/a/b/c.html"),
    ("http://ok.org/a", at(7), "allow", None),
    (None, at(7), "allow", None),
    ("", at(7), "allow", None),
    ("no url", at(7), "allow", None),
    ("http://bad.com/x", None, "allow", None),
    ("http://bad.com/x", at(10), "block", "d:bad.com"),
]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_as_of_join(spark, limit):
    log = spark.createDataFrame(LOG, "kind string, value string, action string, effective_at timestamp")
    rows = [(i, u, t, "clash") for i, (u, t, _, _) in enumerate(CASES)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, verdict string")
    got = {r["page_id"]: r for r in op1_urls.evaluate(captures, log, broadcast_rows=limit).collect()}
    assert len(got) == len(CASES)
    for i, (u, t, verdict, key) in enumerate(CASES):
        assert (got[i]["verdict"], got[i]["matched_key"]) == (verdict, key), (u, t)


def test_without_rows(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", at(1))], "page_id long, url string, fetched_at timestamp")
    log = spark.createDataFrame(LOG, "kind string, value string, action string, effective_at timestamp")
    assert [r["verdict"] for r in op1_urls.evaluate(captures, log.limit(0)).collect()] == ["allow"]
    assert op1_urls.evaluate(captures.limit(0), log).count() == 0


def rows_of(spark, sf, name, sql):
    from barsmith.llm import registry

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = c.sql(sql).df()
    assert sorted(got) == sorted(want)
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(key, norm_rows(got))), sorted(map(key, norm_rows(want)))


def norm_rows(d):
    return [tuple(None if pd.isna(x) else x if isinstance(x, str) else round(float(x), 6) for x in r) for r in d[sorted(d)].itertuples(index=False)]


def test_queries_equal_sql(spark, sf):
    for name, sql in (("op1_urls", op1_urls.ORACLE), ("op4_mixing", op4_mixing.ORACLE)):
        got, want = rows_of(spark, sf, name, sql)
        assert got == want


def fill(sizes, weights, cap=3):
    """Targets by repeated sharing of the excess."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w >= cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def test_targets(spark):
    for sizes in ([10, 20, 30], [1, 1, 1000], [100, 1, 1, 5, 0], [7], [0, 0]):
        rows = [(chr(97 + i), n, 1) for i, n in enumerate(sizes[:-1])] + [(None, sizes[-1], 1)]
        df = spark.createDataFrame(rows, "source string, source_size long, n_docs long")
        got = {r["source"]: r["target"] for r in op4_mixing.targets(df).collect()}
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        for (s, _, _), w in zip(rows, want):
            assert abs(got[s] - w) < 1e-6


def test_tree_keeps_quotas(spark):
    q = [("a", 50), ("b", 7), ("c", 0), (None, 23)]
    df = spark.createDataFrame(q, "source string, quota long")
    for shards in (1, 3, 8):
        leaves = op4_mixing.split_tree(df, shards).collect()
        again = op4_mixing.split_tree(df, shards).collect()
        assert sorted(map(str, leaves)) == sorted(map(str, again))
        sizes = {}
        for s, n in q:
            own = sorted((r["shard"], r["first"], r["n"]) for r in leaves if r["source"] == s)
            assert sum(n for _, _, n in own) == n and [f for _, f, _ in own] == [sum(x[2] for x in own[:i]) for i in range(len(own))]
        for r in leaves:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n"]
        assert max(sizes.values()) - min(sizes.values()) <= 2 and len(sizes) == shards


def test_hypergeometric_law(spark):
    """Every value's share is that of the law."""
    import math

    from pyspark.sql import functions as F

    n = 20_000
    for marked, total, drawn in ((30, 100, 40), (1, 9, 3), (60, 70, 50), (0, 5, 2), (5, 5, 5), (400, 100_000, 250)):
        u = (F.col("id") + 0.5) / n
        got = spark.range(n).select(op4_mixing.hypergeometric(F.lit(marked), F.lit(total), F.lit(drawn), u).alias("x")).groupBy("x").count().collect()
        for r in got:
            law = math.comb(marked, r["x"]) * math.comb(total - marked, drawn - r["x"]) / math.comb(total, drawn)
            assert abs(r["count"] / n - law) < 2 / n
    one = spark.range(1).select(op4_mixing.hypergeometric(F.lit(10**7), F.lit(3 * 10**8), F.lit(15 * 10**7), F.lit(0.5)).alias("x")).first()["x"]
    assert abs(one - 5 * 10**6) < 5


def names_inside():
    """Every name that the operators' modules give a column."""
    import re
    from pathlib import Path

    found = set()
    for p in Path(op4_mixing.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'(?:alias|withColumn)\("(\w+)"', p.read_text()))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


def test_mix_of_odd_rows(spark, odd, wide, empty):
    from pyspark.sql import functions as F

    clash = odd.select("*", *(F.lit("clash").alias(n) for n in names_inside()))
    for docs in (odd, wide, clash):
        m = op4_mixing.mix(docs, shards=3, block_words=20)
        taken = m.dealt(docs).selectExpr("row.doc_id", "size(places) AS n").toPandas()
        assert len(taken) == docs.count() and taken["n"].between(0, 3).all()
        again = op4_mixing.mix(docs, shards=3, block_words=20)
        assert sorted(map(str, again.dealt(docs).select("places").collect())) == sorted(map(str, m.dealt(docs).select("places").collect()))
        out = op4_mixing.mixed(docs, m)
        assert out.columns == docs.columns and out.count() == taken["n"].sum()
    assert op4_mixing.mixed(empty, op4_mixing.mix(empty)).count() == 0


def test_mix_follows_its_tree(spark):
    """Shards hold what the leaves say, positions are a permutation, and partitions hold them in order."""
    rows = [(i, "w " * (1 + i % 37), None, "xyz"[i % 3], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = op4_mixing.mix(docs, shards=5, block_words=500)
    quotas = m.draws.selectExpr("source", "size(draws) AS n").groupBy("source").agg({"n": "sum"}).toDF("source", "quota")
    leaves = {(r["source"], r["shard"]): r["n"] for r in op4_mixing.split_tree(quotas, 5).collect()}
    held = m.draws.selectExpr("source", "explode(draws) AS d").groupBy("source", "d.shard").count().collect()
    assert {(r["source"], r["shard"]): r["count"] for r in held} == {k: n for k, n in leaves.items() if n}
    of_shard = m.rows(docs).select("row.doc_id", "shard", "position").toPandas()
    assert set(of_shard["shard"]) == set(range(5))
    order = of_shard.sort_values(["shard", "position"])["doc_id"].tolist()
    assert order != sorted(order)
    got = [r["doc_id"] for r in op4_mixing.mixed(docs, m).select("doc_id").collect()]
    assert got == order


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 37), None, "xyz"[i % 3], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = op4_mixing.mix(docs, block_words=500)
    got = m.rows(docs).selectExpr("row.source", "size(split(trim(row.text), ' ')) AS t").groupBy("source").sum("t").collect()
    plan = {r["source"]: r["target"] for r in m.plan.collect()}
    for r in got:
        assert abs(r[1] - plan[r["source"]]) <= 40
