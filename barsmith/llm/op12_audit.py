"""Filter interaction audit from a histogram of failure masks.

Each document gets a mask with a bit for every filter that it fails: four bits from
its text alone, the fifth (a copy of an earlier text) from the smallest doc_id of
its text, which a groupBy of texts gives.  Texts are grouped by their SHA-256, so
only narrow rows move, and a copy meets its text's first document by (digest,
doc_id): of a text that millions share only the first one finds a partner, and the
rows of such a group spread by their doc_id.

Documents of one part with one mask are alike in every order of the filters, so a
part's 32 cells (number, good ones, toxic ones) say all: in an order, a cell is
removed at the first filter whose bit it has.  The 120 orders are laid out from the
cells of a part; no document is looked at again.

Edge cases: a null text is empty, a null part is the empty string; blank texts have no
words; rows without a doc_id are copies of none and have no label; repeated rows count
each, and those of the smallest doc_id are copies of none; labels that are null say
nothing, and a doc_id labelled more than once is good or toxic if any row says so; very
long texts are read whole; tables without rows give none; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stage, table

LETTERS = "ABCDE"
_WORDS = r"array_remove(split(body, '[\\x20\\x09-\\x0D]+'), '')"
#: letter -> failure condition over body and words; E, the last bit, is set by ``mark_copies``
FILTERS = {
    "A": "size(words) < 50",
    "B": "100 * size(array_distinct(words)) < 65 * size(words)",
    "C": "100L * length(regexp_replace(body, '[^A-Z]+', '')) > 5L * length(body)",
    "D": "body rlike '[#$%&*|]'",
}


def text_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask) of every document, mask without the last bit."""
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body")).withColumn("words", F.expr(_WORDS))
    bits = " | ".join(f"CASE WHEN {test} THEN {1 << LETTERS.index(name)} ELSE 0 END" for name, test in FILTERS.items())
    return rows.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), F.expr(bits).alias("mask"))


def mark_copies(masks: DataFrame) -> DataFrame:
    """masks with the last bit where a smaller doc_id has the same text."""
    first = masks.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    same = (masks["digest"] == first["digest"]) & (masks["doc_id"] == first["first"])
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return masks.join(first.select("digest", "first"), same, "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the histogram."""
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    each = masks.join(told, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return each.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def _sum(what: str, test: str) -> Column:
    return F.expr(f"aggregate(cells, 0L, (a, c) -> a + CASE WHEN {test} THEN {what} ELSE 0L END)")


def audit(histogram: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step."""
    part = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.lit(["".join(p) for p in permutations(LETTERS)])
    rows = part.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.expr(f"sequence(1, {len(LETTERS)})")).alias("step"))
    bit = lambda letter: f"shiftleft(1, instr('{LETTERS}', {letter}) - 1)"
    rows = rows.select("*", F.expr(bit("substr(filter_order, step, 1)")).alias("bit"), F.expr(f"aggregate(filter(split(filter_order, ''), (x, k) -> k < step - 1), 0, (a, x) -> a | {bit('x')})").alias("before"))
    removed = "(c.mask & before) = 0 AND (c.mask & bit) <> 0"
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        _sum("c.n", "(c.mask & (before | bit)) = 0").alias("kept"),
        _sum("c.n", removed).alias("removed"),
        _sum("c.n", "(c.mask & before) <> 0 AND (c.mask & bit) <> 0").alias("redundant"),
        _sum("c.n", "c.mask = bit").alias("unique_fails"),
        _sum("c.good", removed).alias("good_lost"),
        _sum("c.toxic", removed).alias("toxic_lost"),
        # a document goes by this filter in those orders that have it first among the filters it fails
        _sum(f"c.n * ({len(list(permutations(LETTERS)))} div bit_count(c.mask))", "(c.mask & bit) <> 0").alias("shapley"),
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over every document, by source."""
    masks = stage(text_masks(table(spark, sf_dir, "documents")), "masks")  # narrow rows: the texts are read once
    return audit(cells(mark_copies(masks), table(spark, sf_dir, "labels")))


_PLACE = lambda letter: f"CASE WHEN {letter.lower()} THEN instr(filter_order, '{letter}') ELSE 9 END"
ORACLE = rf"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letter p, letter q, letter r, letter s, letter t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
gone AS (SELECT *, least({', '.join(map(_PLACE, LETTERS))}) AS gone_at, a::INT + b::INT + c::INT + d::INT + e::INT AS fails FROM h, orders),
steps AS (SELECT *, substr(filter_order, step, 1) AS own, CASE own WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failing FROM gone, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
made AS (SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (WHERE gone_at > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE gone_at = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE failing AND gone_at < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failing AND fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE gone_at = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE gone_at = step), 0)::BIGINT AS toxic_lost FROM steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM made"""
