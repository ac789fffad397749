"""URL filter: a blocked Bloom filter before an exact join, and host rules.

The listed URLs are reduced to a canonical form and set into a blocked Bloom
filter of 256-bit blocks, about one for eight listed URLs and at most
``MAX_BLOCKS``, so that its broadcast has a bound (rows of four longs and a
key). A list beyond that raises the share of false hits, never the result:
every possible hit is joined exactly with the list by its canonical URL. Rows
that the filter refuses, and those without a canonical URL, skip the shuffle.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule
and are never listed. Repeated rows are judged one by one; an empty table or list
gives what the rules say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, table

#: Blocks of 256 bits at least and at most; the latter take about 64 MB when broadcast.
MIN_BLOCKS, MAX_BLOCKS = 1 << 10, 1 << 20
#: Listed URLs for each block: one in about 400 others is a false hit then.
PER_BLOCK = 8
LANES = 4
#: (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
#: The list of the query op9_url_filter: URLs on these hosts, and on any host those that a feed has given out.
FEED = r"[?&]utm_source=feed"
SPAM_HOST = r"(^|\.)(spam-farm|cheap-pills)\."


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host, path without a last slash, and sorted non-tracking parameters.

    The scheme, the fragment and tracking parameters are dropped.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), tail)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all subdomains when the path starts with the
    rule's. Of two rules of one length, that with the longer host wins.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in reversed(ranked):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _mask(key: Column, lane: int) -> Column:
    bits = F.xxhash64(key, F.lit(7))
    one = F.lit(1).cast("long")
    at = [F.call_function("shiftrightunsigned", bits, F.lit(12 * lane + s)).bitwiseAND(F.lit(63)).cast("int") for s in (0, 6)]
    return F.call_function("shiftleft", one, at[0]).bitwiseOR(F.call_function("shiftleft", one, at[1]))


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int = MIN_BLOCKS) -> DataFrame:
    """One row for each block that is not empty: block and four 64-bit lanes."""
    lanes = [F.bit_or(_mask(F.col(key), k)).alias(f"lane{k}") for k in range(LANES)]
    return keys.groupBy(_block(F.col(key), n_blocks).alias("block")).agg(*lanes)


def possible_hits(rows: DataFrame, key: str, known: DataFrame, n_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` may be among ``known``, and those whose key isn't, for certain.

    ``known``: one column, materialized. No row is shuffled.
    """
    name = known.columns[0]
    n_blocks = n_blocks or min(max(known.count() // PER_BLOCK, MIN_BLOCKS), MAX_BLOCKS)
    blocks = bloom_blocks(known, name, n_blocks)
    blocks = blocks.select(F.col("block").alias("__block"), *[F.col(f"lane{k}").alias(f"__lane{k}") for k in range(LANES)])
    probed = rows.withColumn("__block", _block(F.col(key), n_blocks)).join(F.broadcast(blocks), "__block", "left")
    held = [F.col(f"__lane{k}").bitwiseAND(_mask(F.col(key), k)) == _mask(F.col(key), k) for k in range(LANES)]
    possible = F.coalesce(reduce(Column.__and__, held), F.lit(False))
    return probed.where(possible).select(rows.columns), probed.where(~possible).select(rows.columns)


def listed_urls(rows: DataFrame, key: str, listed: DataFrame, url: str = "url", n_blocks: int | None = None) -> DataFrame:
    """``rows`` with a boolean ``listed``: is its canonical URL ``key`` in the list?

    ``listed`` has URLs of any form in column ``url``; nulls in it are ignored.
    An empty key is never listed, and so never a hit: it isn't in the list.
    """
    known = listed.where(F.col(url).contains("://")).select(canonical_url(F.col(url)).alias("__listed")).distinct()
    known = materialize(known.where(F.col("__listed") != ""), "listed")
    # Rows without a key would be one hot key of the join, if their bits were set by others.
    hits, misses = possible_hits(rows.where(F.col(key) != ""), key, known, n_blocks)
    misses = misses.unionByName(rows.where(F.col(key) == ""))
    exact = hits.join(known.withColumn("listed", F.lit(True)), F.col(key) == F.col("__listed"), "left")
    exact = exact.select(*rows.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    return exact.unionByName(misses.select("*", F.lit(False).alias("listed")))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", n_blocks: int | None = None) -> DataFrame:
    """Judge each URL: page_id, host, path, rule, verdict, listed.

    The longest fitting rule decides; without one, a URL is blocked when its
    canonical form is in ``listed`` and allowed otherwise. Other columns of
    ``pages``, whatever their names, are left out.
    """
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), F.when(u.contains("://"), canonical_url(u)).otherwise(F.lit("")).alias("canon"))
    judged = listed_urls(rows, "canon", listed, n_blocks=n_blocks)
    judged = judged.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "listed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, against the rules and a list of URLs of spam hosts and of a feed."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(host_of(F.col("url")).rlike(SPAM_HOST) | F.col("url").rlike(FEED)).select("url")
    return filter_urls(pages, listed)


SQL = r"""
WITH u AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS q
  FROM pages
), c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
      host || regexp_replace(path, '/$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END
    ELSE '' END AS canon
  FROM u
), listed AS (
  SELECT DISTINCT canon FROM c
  WHERE contains(url, '://')
    AND (regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') OR regexp_matches(url, '[?&]utm_source=feed'))
), r AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    canon IN (SELECT canon FROM listed) AS listed
  FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
