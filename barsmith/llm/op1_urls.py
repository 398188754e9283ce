"""URL filter: an as-of join of captures with a dated block and allow list.

The list is a log: at a time, an entry (a domain with its subdomains, a path
prefix of a host, or one URL) starts to block or allow, or is lifted.  The log
becomes validity intervals [valid_from, valid_to), one state an entry at a time.
A capture is held against the entries that are active at its fetch time: of
those that match, the most specific decides (URL before the longest path prefix
before the longest domain).

Captures are joined by key.  Each distinct (url, fetched_at) gives its candidate
keys, no more than it has labels and path segments (segments only as deep as
some entry goes).  Intervals are cut at the borders of time buckets, so the join
is an equality on (key, bucket) and the range test only picks among the few
intervals of one key in one bucket.  A list of known small size is broadcast; a
larger one meets the keys in a sort-merge join, whose hot keys Spark splits.

Paths are compared in lower case and without their query string and fragment, on both sides: an
entry that names a query string matches nothing.

Edge cases: a null or unusable url matches nothing and is kept; a null fetch
time is evaluated at no time, so it is kept too; log rows with a null in kind,
value, action or time are void; of several rows of an entry at one time the
last by action name holds; repeated captures each keep their row; an empty list
keeps every capture, no captures give none; further columns of captures stay,
and those named like the result's (``host``, ``verdict``, ...) give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUCKET_DAYS = 30
#: Interval rows up to which the list is broadcast (each has a key, two times and a flag).
BROADCAST_ROWS = 100_000
FOREVER = "9999-12-31 00:00:00"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; empty if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"\.$", "")


def url_path(url: Column) -> Column:
    """Path without query and fragment, from its first slash; / if there is none."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def intervals(log: DataFrame) -> DataFrame:
    """(key, depth, blocks, valid_from, valid_to) from a log of (kind, value, action, effective_at).

    kind: domain, prefix (host/path), url (host/path, exact); action: block, allow, lift."""
    log = log.select("kind", F.lower("value").alias("value"), "action", F.col("effective_at").cast("timestamp").alias("at"))
    log = log.where("kind in ('domain', 'prefix', 'url') and action in ('block', 'allow', 'lift') and value is not null and at is not null")
    key = F.when(F.col("kind") == "domain", F.concat(F.lit("d:"), "value")).when(F.col("kind") == "url", F.concat(F.lit("u:"), "value")).otherwise(F.concat(F.lit("p:"), F.rtrim("value", F.lit("/"))))
    log = log.withColumn("key", key).groupBy("key", "at").agg(F.max("action").alias("action"))
    entry = Window.partitionBy("key").orderBy("at")
    spans = log.withColumn("valid_to", F.coalesce(F.lead("at").over(entry), F.lit(FOREVER).cast("timestamp")))
    depth = F.when(F.col("key").startswith("p:"), F.size(F.split("key", "/")) - 1).otherwise(0)
    return spans.where("action <> 'lift'").select("key", depth.alias("depth"), (F.col("action") == "block").alias("blocks"), F.col("at").alias("valid_from"), "valid_to")


def bucket(at: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(at) / F.lit(86400 * days))


def candidates(deepest: int) -> Column:
    """Keys that can match a capture, with a rank that grows with how specific they are."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")).alias("key"), (F.lit(1000) - i).alias("rank")))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    reach = F.least(F.size(parts), F.lit(deepest))
    prefixes = F.when(reach > 0, F.transform(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))), lambda i: F.struct(F.concat(F.lit("p:"), "host", F.lit("/"), F.lower(F.array_join(F.slice(parts, 1, i), "/"))).alias("key"), (F.lit(1000) + i).alias("rank"))))
    none = F.array().cast("array<struct<key:string,rank:int>>")
    exact = F.array(F.struct(F.concat(F.lit("u:"), "host", F.lower("path")).alias("key"), F.lit(1_000_000).alias("rank")))
    return F.concat(domains, F.coalesce(prefixes, none), exact)


def evaluate(captures: DataFrame, log: DataFrame, bucket_days: int = BUCKET_DAYS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures (url, fetched_at and other columns) with host, matched_key, verdict (allow or block) and listed_since."""
    spans = intervals(log)
    sizes = spans.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    own = [c for c in captures.columns if c.lower() not in ("host", "matched_key", "verdict", "listed_since")]
    captures = captures.select(*own, url_host(F.col("url")).alias("host"))
    at = captures.where("host <> '' and fetched_at is not null").select("url", F.col("fetched_at").cast("timestamp").alias("at")).distinct()
    # an interval is laid into the buckets in which there are captures
    reach = at.agg(F.min(bucket(F.col("at"), bucket_days)).alias("lo"), F.max(bucket(F.col("at"), bucket_days)).alias("hi")).first()
    if not sizes["n"] or reach["lo"] is None:
        nothing = F.lit(None).cast("string")
        return captures.select("*", nothing.alias("matched_key"), F.lit("allow").alias("verdict"), F.lit(None).cast("timestamp").alias("listed_since"))
    first = F.greatest(bucket(F.col("valid_from"), bucket_days), F.lit(reach["lo"]))
    last = F.least(bucket(F.col("valid_to"), bucket_days), F.lit(reach["hi"]))
    laid = spans.withColumns({"first": first, "last": last}).where("first <= last")
    laid = laid.select("key", "blocks", "valid_from", "valid_to", F.explode(F.sequence("first", "last")).alias("bucket"))
    if sizes["n"] * (reach["hi"] - reach["lo"] + 1) <= broadcast_rows:
        laid = F.broadcast(laid)
    keys = at.select("url", "at", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keys = keys.select("url", "at", bucket(F.col("at"), bucket_days).alias("bucket"), F.explode(candidates(sizes["deepest"] or 0)).alias("c"))
    keys = keys.select("url", "at", "bucket", "c.key", "c.rank")
    hits = keys.join(laid, ["key", "bucket"]).where("valid_from <= at and at < valid_to")
    best = hits.groupBy("url", "at").agg(F.max(F.struct("rank", "key", "blocks", "valid_from")).alias("m"))
    best = best.select(F.col("url").alias("m_url"), F.col("at").alias("m_at"), "m")
    out = captures.join(best, (F.col("url") == F.col("m_url")) & (F.col("fetched_at").cast("timestamp") == F.col("m_at")), "left")
    return out.select(*own, "host", F.col("m.key").alias("matched_key"), F.when(F.col("m.blocks"), "block").otherwise("allow").alias("verdict"), F.col("m.valid_from").alias("listed_since"))


#: The pages have no fetch times and no list, so the query sets both by rule: page p is fetched p mod 90 days
#: after this day, and hosts and first path segments enter the log by a hash of their names.
FIRST_DAY = "2024-01-01"


def fetched(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(f"timestamp'{FIRST_DAY} 00:00:00' + make_dt_interval(coalesce(cast(pmod(page_id, 90) as int), 0))").alias("fetched_at"))


def list_log(pages: DataFrame) -> DataFrame:
    """The log: of 8 hosts one is blocked on day 10, one blocked on day 20 and lifted on day 50, one blocked
    on day 5, lifted on day 30 and blocked again on day 60; of 4 paths one is allowed on day 15, one blocked on day 25."""
    digit = lambda c, n: F.pmod(F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int"), F.lit(n))
    hosts = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).where("host <> ''").distinct()
    domains = hosts.select("host").distinct().select(F.lit("domain").alias("kind"), F.col("host").alias("value"), digit(F.col("host"), 8).alias("h"))
    rows = F.when(F.col("h") == 0, F.expr("array(('block', 10))")).when(F.col("h") == 1, F.expr("array(('block', 20), ('lift', 50))")).when(F.col("h") == 2, F.expr("array(('block', 5), ('lift', 30), ('block', 60))"))
    paths = hosts.select(F.concat("host", F.lit("/"), F.lower(F.regexp_extract("path", "^/+([^/]+)", 1))).alias("value")).where(~F.col("value").endswith("/")).distinct()
    paths = paths.select(F.lit("prefix").alias("kind"), "value", digit(F.col("value"), 4).alias("h"))
    deeds = F.when(F.col("h") == 0, F.expr("array(('allow', 15))")).when(F.col("h") == 1, F.expr("array(('block', 25))"))
    log = domains.select("kind", "value", F.explode(rows).alias("e")).union(paths.select("kind", "value", F.explode(deeds).alias("e")))
    return log.select("kind", "value", F.col("e.col1").alias("action"), F.expr(f"timestamp'{FIRST_DAY} 00:00:00' + make_dt_interval(e.col2)").alias("effective_at"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = evaluate(fetched(pages), list_log(pages))
    return out.select("page_id", "url", "host", "matched_key", "verdict", F.datediff("listed_since", F.lit(FIRST_DAY)).alias("listed_day"))


ORACLE = r"""
WITH pages_ AS (
  SELECT page_id, url, coalesce(((page_id % 90) + 90) % 90, 0) AS day,
         regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host_,
         regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path0
  FROM pages
), p AS (SELECT page_id, url, day, host_ AS host, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM pages_),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT % 8 AS h FROM p WHERE host <> ''),
paths AS (
  SELECT value, ('0x' || substr(md5(value), 1, 4))::INT % 4 AS h
  FROM (SELECT DISTINCT host || '/' || lower(regexp_extract(path, '^/+([^/]+)', 1)) AS value FROM p WHERE host <> '') WHERE NOT ends_with(value, '/')
), spans AS (
  SELECT 'd:' || host AS key, true AS blocks, 10 AS a, 1000000 AS b FROM hosts WHERE h = 0
  UNION ALL SELECT 'd:' || host, true, 20, 50 FROM hosts WHERE h = 1
  UNION ALL SELECT 'd:' || host, true, 5, 30 FROM hosts WHERE h = 2
  UNION ALL SELECT 'd:' || host, true, 60, 1000000 FROM hosts WHERE h = 2
  UNION ALL SELECT 'p:' || value, false, 15, 1000000 FROM paths WHERE h = 0
  UNION ALL SELECT 'p:' || value, true, 25, 1000000 FROM paths WHERE h = 1
), labels_ AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host <> ''),
domains AS (SELECT host, 'd:' || array_to_string(l[i:len(l)], '.') AS key, 1000 - i AS rank FROM labels_, unnest(range(1, len(l) + 1)) AS u(i)),
keys AS (
  SELECT p.page_id, p.url, p.day, d.key, d.rank FROM p JOIN domains d USING (host)
  UNION ALL SELECT page_id, url, day, 'p:' || host || '/' || lower(regexp_extract(path, '^/+([^/]+)', 1)), 1001 FROM p WHERE host <> '' AND regexp_extract(path, '^/+([^/]+)', 1) <> ''
), best AS (
  SELECT url, day, arg_max(k.key, rank) AS key, arg_max(blocks, rank) AS blocks, arg_max(a, rank) AS a
  FROM keys k JOIN spans s ON k.key = s.key AND s.a <= day AND day < s.b GROUP BY url, day
)
SELECT p.page_id, p.url, p.host, best.key AS matched_key, CASE WHEN best.blocks THEN 'block' ELSE 'allow' END AS verdict, best.a AS listed_day
FROM p LEFT JOIN best ON p.url = best.url AND p.day = best.day
"""
