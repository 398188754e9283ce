"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) by source give each source's target: weights share the total,
   no target above CAP times its source's size, the excess shared anew by weight.
2. A hash deals a source's documents to blocks of about BLOCK_WORDS words (more
   where the corpus would have over MOST_BLOCKS of them).  The target asks for so
   many whole epochs of all blocks and for a part of one more: blocks in hash
   order until the next would not fit, and of that one documents in hash order as
   long as each brings the total nearer.  These are the source's draws, its exact quota.
3. The tree deals the draws to output shards: a node holds a quota for each
   source and some shards; its left half gets as many slots as its shards are
   due, and of each source a hypergeometric number, conditioned on those before.
   Leaves hold exact quotas that sum to the sources' quotas.
4. A shard takes the next disjoint draws of each source's permutation, and its
   documents come in the order of a hash: the local shuffle.

A document is taken as often as leaves of the tree hold draws of its block, and
each time it has a shard and a position.  All of it is DataFrame and SQL
expressions on hashes of ids, so reruns agree.  Nothing is kept per document but
(doc_id, source, size, hash), staged once; tables of blocks and draws have at most
MOST_BLOCKS rows and one a source, times the epochs.

Edge cases: a null or empty text has size 0 and is drawn with its block; a null
source is a source of its own and comes last; sources of size 0 have target 0;
rows that repeat a doc_id share a block and come in or stay out together, rows
with a null doc_id are told apart by their texts; an empty table gives an empty
one; clashing further columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, release, stage, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a block at least, and blocks in all about.
BLOCK_WORDS, MOST_BLOCKS = 100_000, 1 << 20
#: Output shards: at least, blocks that each has about, at most.
LEAST_SHARDS, SHARD_BLOCKS, MOST_SHARDS = 8, 64, 1 << 14
#: Rows of a counted table up to which it is broadcast.
BROADCAST_ROWS = 100_000
SEED = "mix"
HASH_BITS = 60


def hashed(*parts: Column | str) -> Column:
    """60 bits of an md5 of texts, as a long: the same in Spark and in SQL."""
    text = F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def own_hash() -> Column:
    """The hash of a document: of its id, or of its text where it has none."""
    return hashed(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit(""))))))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash): words of each whole text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), own_hash().alias("hash"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, weight, target) for rows (source, source_size, n_docs).

    The sources are ranked and filled in one task: there are as many rows as sources.  Filling in the
    order of cap / weight, a source is capped while its cap is below its share of what is left."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = by_source.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights)).cast("int") + 1))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("share", F.col("left_size") / F.col("left_weight"))
    rows = rows.withColumn("capped", F.col("most") <= F.col("share") * F.col("weight"))
    # once a source is not capped none after it is: they share what is left by weight
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("level", F.min(F.when(~F.col("capped"), F.struct("k", "share"))).over(everything)["share"])
    return rows.select("source", "source_size", "n_docs", "weight", F.when(F.col("capped"), F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target"))


@dataclass
class Mix:
    docs: DataFrame  # staged (doc_id, source, size, hash, block, place): place orders documents in a block
    plan: DataFrame  # staged (source, source_size, target, epochs, rest, n_blocks)
    draws: DataFrame  # staged (source, block, draws): draws an array of (epoch, shard, cut), cut null for whole draws
    shards: int
    n_sources: int
    n_blocks: int

    def dealt(self, docs: DataFrame) -> DataFrame:
        """(row, places): each row of docs (with doc_id, source and text) as a struct, and the array of its
        (shard, position, epoch), one for each time the mix takes it.

        Every row finds its block by its own hash, so no text moves."""
        p = sized(self.plan.select(F.struct("source").alias("of"), "n_blocks"), self.n_sources)
        d = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("source").cast("string").alias("source")).alias("own"), own_hash().alias("hash"))
        d = d.join(p, F.expr("own <=> of"))
        d = d.select("row", "hash", F.expr("struct(own.source, hash % n_blocks as block)").alias("own"), F.expr("hash div n_blocks").alias("place"))
        b = sized(self.draws.select(F.struct("source", "block").alias("of"), "draws"), self.n_blocks)
        d = d.join(b, F.expr("own <=> of"), "left")
        taken = F.filter("draws", lambda x: x["cut"].isNull() | (F.col("place") <= x["cut"]))
        place = lambda x: F.struct(x["shard"].alias("shard"), hashed(F.col("hash"), x["epoch"], F.lit("order")).alias("position"), x["epoch"].alias("epoch"))
        return d.select("row", F.coalesce(F.transform(taken, place), F.array().cast("array<struct<shard:int,position:bigint,epoch:int>>")).alias("places"))

    def rows(self, docs: DataFrame) -> DataFrame:
        """(row, shard, position, epoch): the mixture; within a shard its order is that of position."""
        return self.dealt(docs).select("row", F.explode("places").alias("at")).select("row", "at.*")


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of the marked are among drawn of total, for a uniform u in [0, 1): the inverse of the law.

    Probabilities relative to the mode's follow from their ratios; beyond 12 standard deviations and 20
    from the mode they are below what a double adds to the sum, so a draw takes steps as the square root of its size."""
    zero = F.lit(0).cast("long")
    steps = lambda a, b: F.filter(F.sequence(a, F.greatest(a, b)), lambda x: x <= b)
    weight = lambda w, s: F.struct(w.alias("w"), s.alias("s"))

    def ratio(g, x):  # P(x + 1) / P(x)
        return (g["k"] - x) * (g["n"] - x) / ((x + 1) * (g["t"] - g["k"] - g["n"] + x + 1))

    def range_of(g):
        t = F.greatest(g["t"], F.lit(2.0))
        mode = F.floor((g["n"] + 1) * (g["k"] + 1) / (g["t"] + 2)).cast("long")
        reach = (F.ceil(F.sqrt(F.greatest(F.lit(0.0), g["n"] * (g["k"] / t) * (1 - g["k"] / t) * (t - g["n"]) / (t - 1))) * 12) + 20).cast("long")
        low = F.greatest(zero, (g["n"] + g["k"] - g["t"]).cast("long"), mode - reach)
        high = F.least(g["n"].cast("long"), g["k"].cast("long"), mode + reach)
        return F.struct(g["k"].alias("k"), g["n"].alias("n"), g["t"].alias("t"), g["u"].alias("u"), mode.alias("mode"), low.alias("low"), high.alias("high"))

    def sides(g):
        below = F.aggregate(F.reverse(steps(g["low"], g["mode"] - 1)), weight(F.lit(1.0), F.lit(0.0)), lambda a, x: bound(a["w"] / ratio(g, x), lambda w: weight(w, a["s"] + w)))
        above = F.aggregate(steps(g["mode"], g["high"] - 1), weight(F.lit(1.0), F.lit(1.0)), lambda a, x: bound(a["w"] * ratio(g, x), lambda w: weight(w, a["s"] + w)))
        return F.struct(g.alias("g"), below.alias("below"), above.alias("above"))

    def walk(r):
        g, goal = r["g"], r["g"]["u"] * (r["below"]["s"] + r["above"]["s"])
        start = F.struct(r["below"]["w"].alias("w"), F.lit(0.0).alias("s"), zero.alias("x"), goal.alias("goal"))
        step = lambda a, x: F.struct((a["w"] * ratio(g, x)).alias("w"), (a["s"] + a["w"]).alias("s"), (a["x"] + (a["s"] + a["w"] <= a["goal"]).cast("long")).alias("x"), a["goal"].alias("goal"))
        return F.least(g["high"], g["low"] + F.aggregate(steps(g["low"], g["high"]), start, step)["x"])

    given = F.struct(*(c.cast("double").alias(x) for x, c in (("k", marked), ("n", drawn), ("t", total), ("u", u))))
    return bound(bound(bound(given, range_of), sides), walk)


def unit(*parts: Column) -> Column:
    """In [0, 1), by a hash of the parts."""
    return hashed(*parts) / F.lit(float(1 << HASH_BITS))


def split_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(source, shard, first, n): each shard's exact quota of each source, and where in the source's draws it begins.

    quotas: (source, quota).  A level splits every node at once; a node is a row with an array over the sources."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("quota").cast("long").alias("quota")))).alias("q"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("q", lambda x: x["source"]).alias("sources"), F.transform("q", lambda x: x["quota"]).alias("q")).where("size(q) > 0")
    width = 1
    while width < shards:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        due = F.round(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        start = F.struct(F.col("due").alias("drawn"), F.col("total").alias("rest"), F.array().cast("array<long>").alias("got"))
        node = node.withColumn("mid", mid).withColumn("total", total).withColumn("due", due)
        node = node.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate(F.sequence(F.lit(1), F.size("q")), start, _split_source)["got"]))
        halves = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "q"))).otherwise(F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("q")), F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("q", "left", lambda a, b: a - b).alias("q"))))
        node = stage(node.select("sources", F.explode(halves).alias("h")).select("h.lo", "h.hi", "sources", "h.q"), "tree")
        width *= 2
    leaf = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("sources", "q")).alias("x")).select("shard", F.col("x.sources").alias("source"), F.col("x.q").alias("n"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.select("source", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def _split_source(state: Column, i: Column) -> Column:
    """One more source of a node: how many of its draws go left, given those of the sources before."""
    own = F.element_at("q", i)
    left = hypergeometric(own, state["rest"], state["drawn"], unit(F.col("lo"), F.col("hi"), i))
    return bound(left, lambda x: F.struct((state["drawn"] - x).alias("drawn"), (state["rest"] - own).alias("rest"), F.concat(state["got"], F.array(x)).alias("got")))


def cuts(placed: DataFrame, blocks: DataFrame, n_sources: int) -> DataFrame:
    """(source, block, cut): the last place that the partly drawn block of a source still gives, if any."""
    some = sized(blocks.where("part > 0").select(F.struct("source", "block").alias("of"), "part"), n_sources)  # a row a source
    d = placed.where("size > 0").join(some, F.expr("struct(source, block) <=> of"))
    d = d.groupBy("source", "block", "place").agg(F.sum("size").alias("size"), F.first("part").alias("part"))
    inside = Window.partitionBy("source", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("fits", 2 * F.sum("size").over(inside) - F.col("size") <= 2 * F.col("part")).where("fits")
    return d.groupBy("source", "block").agg(F.max("place").alias("cut"))


def mix(docs: DataFrame, shards: int | None = None, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block_words: int = BLOCK_WORDS) -> Mix:
    base = stage(sizes(docs), "sizes")
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stage(plan.withColumn("rest", F.greatest(F.lit(0).cast("long"), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))), "plan")
    seen = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    n_sources, width = seen["n"], max(block_words, -(-seen["words"] // MOST_BLOCKS))
    plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(width))).cast("long"))
    p = sized(plan.select(F.struct("source").alias("of"), "n_blocks"), n_sources)
    placed = base.join(p, F.expr("struct(source) <=> of"))
    placed = placed.select("doc_id", "source", "size", "hash", (F.col("hash") % F.col("n_blocks")).alias("block"), F.expr("hash div n_blocks").alias("place"))
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    # a window a source, over MOST_BLOCKS rows at most
    turn = Window.partitionBy("source").orderBy("key", "block")
    blocks = blocks.withColumn("key", hashed("source", "block")).withColumn("turn", F.row_number().over(turn) - 1).withColumn("until", F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    q = sized(plan.select(F.struct("source").alias("of"), "epochs", "rest"), n_sources)
    blocks = blocks.join(q, F.expr("struct(source) <=> of"))
    # blocks that fit into the rest are drawn once more; the first that does not is drawn in part
    fits, begun = F.col("until") <= F.col("rest"), F.col("until") - F.col("words") < F.col("rest")
    blocks = blocks.select("source", "block", "turn", (F.col("epochs") + F.when(fits & (F.col("rest") > 0), 1).otherwise(0)).cast("long").alias("copies"), F.when(begun & ~fits, F.col("rest") - F.col("until") + F.col("words")).otherwise(0).alias("part"))
    blocks = stage(blocks, "blocks")
    n_blocks = blocks.count()
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, n_blocks // SHARD_BLOCKS))
    draws = blocks.withColumn("m", (F.col("copies") + (F.col("part") > 0).cast("long")).cast("int")).where("m > 0")
    draws = draws.select("source", "block", "turn", "copies", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("epoch"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("epoch", "turn")) - 1
    draws = stage(draws.select("source", "block", "epoch", (F.col("epoch") >= F.col("copies")).alias("partial"), number.alias("number")), "numbered")
    leaves = split_tree(draws.groupBy("source").agg(F.count("*").alias("quota")), shards)
    s = leaves.where("n > 0").select(F.col("source").alias("of"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    c = cuts(placed, blocks, n_sources)
    d = draws.alias("d").join(s, F.expr("d.source <=> of and d.number = at")).join(c.alias("c"), F.expr("d.source <=> c.source and d.block = c.block"), "left")
    # a partial draw of a block of which nothing fits takes nothing
    cut = F.when(F.col("partial"), F.coalesce("cut", F.lit(-1).cast("long")))
    d = d.select("d.source", "d.block", F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("shard").cast("int").alias("shard"), cut.alias("cut")).alias("draw"))
    held = stage(d.groupBy("source", "block").agg(F.array_sort(F.collect_list("draw")).alias("draws")), "draws")  # cap + 1 draws a block at most
    release(blocks, draws)
    return Mix(placed, plan, held, shards, n_sources, n_blocks)


def mixed(docs: DataFrame, m: Mix) -> DataFrame:
    """The mixture: rows of docs as often as the mix takes them, all columns kept, shard after shard in the
    order of their positions when the partitions are read in turn."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = (F.col("shard") + F.col("position") / F.lit(float(1 << HASH_BITS))) * F.lit(n / m.shards)
    rows = m.rows(docs).withColumn("part", F.least(F.floor(along), F.lit(n - 1)).cast("int"))
    return rows.repartitionById(n, "part").sortWithinPartitions("shard", "position", "epoch").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    p = sized(m.plan.select(F.struct("source").alias("of"), "source_size", "target"), m.n_sources)
    docs = m.docs.select("doc_id", "source", "size", "block", "place", "hash")
    rows = docs.join(p, F.expr("struct(source) <=> of")).drop("of")
    b = sized(m.draws.select(F.struct("source", "block").alias("of"), "draws"), m.n_blocks)
    rows = rows.join(b, F.expr("struct(source, block) <=> of"), "left")
    taken = F.coalesce(F.filter("draws", lambda x: x["cut"].isNull() | (F.col("place") <= x["cut"])), F.array().cast(m.draws.schema["draws"].dataType))
    places = F.array_join(F.transform(taken, lambda x: F.concat_ws(":", x["shard"], hashed(F.col("hash"), x["epoch"], F.lit("order")))), ",")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(taken)).alias("taken"), places.alias("places"))


def _sql_hash(*parts: str) -> str:
    text = " || '|' || ".join([f"'{SEED}'", *(f"coalesce(CAST({p} AS VARCHAR), '-')" for p in parts)])
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


#: log of a hypergeometric probability but for what does not depend on x.
_SQL_LAW = "(- lgamma(x + 1) - lgamma(k - x + 1) - lgamma(n - x + 1) - lgamma(t - k - n + x + 1))"
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ 	-
]+')) END::BIGINT AS size,
         {_sql_hash("coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))")} AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((rank - 1) % 3) + 1] AS weight, source_size * 3.0::DOUBLE AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS k FROM w),
c AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS share FROM o
), l AS (SELECT arg_min(share, k) AS level FROM c WHERE NOT most <= share * weight),
t AS (SELECT source, source_size, CASE WHEN most <= share * weight THEN most ELSE (SELECT level FROM l) * weight END AS target FROM c),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
  greatest(1, ceil(source_size / greatest({BLOCK_WORDS}, ceil((SELECT sum(source_size) FROM s) / {MOST_BLOCKS}.0))))::BIGINT AS n_blocks FROM t),
p2 AS (SELECT *, greatest(0, round(target - epochs * source_size))::BIGINT AS rest FROM plan),
placed AS (SELECT d.*, p2.source_size, target, epochs, rest, h % n_blocks AS block, h // n_blocks AS place
  FROM d JOIN p2 ON d.source IS NOT DISTINCT FROM p2.source),
b AS (SELECT source, block, sum(size) AS words, any_value(rest) AS rest, any_value(epochs) AS epochs, {_sql_hash('source', 'block')} AS key FROM placed GROUP BY source, block),
b2 AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, block ROWS UNBOUNDED PRECEDING) AS until,
  row_number() OVER (PARTITION BY source ORDER BY key, block) AS turn FROM b),
b3 AS (SELECT source, block, turn, epochs + (until <= rest AND rest > 0)::BIGINT AS copies, CASE WHEN until - words < rest AND until > rest THEN rest - until + words ELSE 0 END AS part FROM b2),
cuts AS (
  SELECT source, block, max(place) AS cut FROM (
    SELECT g.source, g.block, place, 2 * sum(size) OVER (PARTITION BY g.source, g.block ORDER BY place ROWS UNBOUNDED PRECEDING) - size <= 2 * part AS fits
    FROM (SELECT source, block, place, sum(size) AS size FROM placed WHERE size > 0 GROUP BY source, block, place) g
    JOIN b3 ON g.source IS NOT DISTINCT FROM b3.source AND g.block = b3.block WHERE part > 0
  ) WHERE fits GROUP BY source, block
), draws AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY epoch, turn) - 1 AS number
  FROM (SELECT source, block, turn, epoch, epoch >= copies AS partial FROM b3, unnest(range(copies + (part > 0)::BIGINT)) AS u(epoch))
), quotas AS (SELECT source, count(*) AS quota FROM draws GROUP BY source),
top AS (SELECT list(quota::DOUBLE ORDER BY encode(source) NULLS LAST) AS q, list(source ORDER BY encode(source) NULLS LAST) AS sources,
  (SELECT least({MOST_SHARDS}, greatest({LEAST_SHARDS}, count(*) // {SHARD_BLOCKS})) FROM b3) AS shards FROM quotas),
tree AS (
  SELECT 0::BIGINT AS lo, shards::BIGINT AS hi, 1 AS i, q, []::DOUBLE[] AS got,
    round(list_sum(q) * (shards // 2) / shards) AS n, list_sum(q) AS t FROM top WHERE len(q) > 0
  UNION ALL
  SELECT r.lo, r.hi, r.i, r.q, r.got, r.n, r.t FROM (
    SELECT unnest(CASE WHEN i <= len(q) THEN [{{'lo': lo, 'hi': hi, 'i': i + 1, 'q': q, 'got': list_append(got, x), 'n': n - x, 't': t - q[i]}}]
      ELSE [{{'lo': lo, 'hi': mid, 'i': 1, 'q': got, 'got': []::DOUBLE[], 'n': round(list_sum(got) * ((lo + mid) // 2 - lo) / (mid - lo)), 't': list_sum(got)}},
            {{'lo': mid, 'hi': hi, 'i': 1, 'q': others, 'got': []::DOUBLE[], 'n': round(list_sum(others) * ((mid + hi) // 2 - mid) / (hi - mid)), 't': list_sum(others)}}] END) AS r
    FROM (
      SELECT *, (lo + hi) // 2 AS mid, [a[1] - a[2] for a in list_zip(q, got)] AS others,
        lo_x + len([j for j in range(1, len(law) + 1) if list_sum(law[1:j]) <= u * list_sum(law)]) AS x
      FROM (
        SELECT *, {_sql_hash('lo', 'hi', 'i')} / 1152921504606846976.0::DOUBLE AS u, greatest(0, n + k - t) AS lo_x,
          [exp({_SQL_LAW} - list_max([{_SQL_LAW} for x in range(greatest(0, n + k - t)::BIGINT, least(n, k)::BIGINT + 1)])) for x in range(greatest(0, n + k - t)::BIGINT, least(n, k)::BIGINT + 1)] AS law
        FROM (SELECT *, coalesce(q[i], 0.0) AS k FROM tree WHERE hi - lo > 1)
      )
    )
  )
), leaf AS (SELECT lo AS shard, unnest(q) AS n, unnest((SELECT sources FROM top)) AS source FROM tree WHERE hi - lo = 1 AND i = 1),
spans AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY shard ROWS UNBOUNDED PRECEDING) AS past FROM leaf),
dealt AS (
  SELECT draws.*, shard, cut FROM draws JOIN spans ON draws.source IS NOT DISTINCT FROM spans.source AND number >= past - n AND number < past
  LEFT JOIN cuts ON draws.source IS NOT DISTINCT FROM cuts.source AND draws.block = cuts.block
), held AS (SELECT source, block, list({{'epoch': epoch, 'shard': shard, 'cut': CASE WHEN partial THEN coalesce(cut, -1) END}} ORDER BY epoch) AS ds FROM dealt GROUP BY source, block),
x AS (
  SELECT placed.*, [e for e in coalesce(ds, []) if e.cut IS NULL OR place <= e.cut] AS taken_
  FROM placed LEFT JOIN held ON placed.source IS NOT DISTINCT FROM held.source AND placed.block = held.block
)
SELECT doc_id, size, source_size, target, size * len(taken_) AS taken,
  array_to_string([e.shard || ':' || {_sql_hash('h', 'e.epoch', "'order'")} for e in taken_], ',') AS places FROM x
"""
