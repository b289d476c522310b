"""Operator 8 (native): URL rules, and a blocked Bloom filter over listed canonical URLs.

Rules allow or block a host, its subdomains and a path prefix; the longest that fits
decides. Other URLs are judged by a list: a blocked Bloom filter (a 64-bit block for
each key, PROBES bits in it) of the listed canonical URLs lets all listed URLs and a
few others pass as possible hits; those alone go to an exact hash join with the list,
which removes the false ones. All of it is DataFrame expressions; the filter is
broadcast while its size, known from the list's count, is below MOST_BYTES, and joined
by its block's number beyond. Urls that a rule judges, and null ones, aren't looked up.

A URL that is null or has no `://` has an empty host and path, fits no rule and isn't
listed, so it is allowed. Listed nulls and repeats change nothing. Repeated rows get a
row each; a url that a third of all rows share is looked up by a join that adaptive
execution may split, as the list has it once. Very long urls are compared whole. Columns
pass through, but for those named like a result, which the result replaces; empty tables
are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm.common import ascii_lower, fresh, settle, table

#: Fixed values: (verdict, host, path) of the rules to apply.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The block list of the query: urls on these hosts, and those that a campaign brought in; other forms of them
#: (scheme, www., last slash, fragment, without the campaign's mark) are listed by their canonical form too.
SPAM = r"(^|\.)(spam-farm|free-bets|casino-win)\."
CAMPAIGN = r"[?&]utm_source="
BITS_PER_KEY = 12
PROBES = 6
MOST_BYTES = 64 << 20


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without www., path without its last slash, query without utm_ parameters; null where there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), "^&", "")
    short = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/$", ""))
    return F.when(host != "", F.when(query == "", short).otherwise(F.concat(short, F.lit("?"), query)))


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column) -> Column:
    """The PROBES bits of a key in its block."""
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    return reduce(Column.bitwiseOR, (F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(h, 6 * k), F.lit(64)).cast("int")) for k in range(PROBES)))


def listed(spark: SparkSession, df: DataFrame, key: str, listing: DataFrame, to: str) -> DataFrame:
    """df with a boolean column to: whether key is among listing (one column, key)."""
    listing = settle(spark, listing.where("key is not null").distinct())
    blocks = max(1, -(-listing.count() * BITS_PER_KEY // 64))
    block, mask, own, known = fresh(df, "bloom_block", "bloom_mask", "bloom_own", "listed_key")
    bloom = listing.groupBy(block_of(F.col("key"), blocks).alias(block)).agg(F.bit_or(bits_of(F.col("key"))).alias(mask))
    if 16 * blocks <= MOST_BYTES:
        bloom = F.broadcast(bloom)
    probed = df.withColumn(block, block_of(F.col(key), blocks)).join(bloom, block, "left").withColumn(own, bits_of(F.col(key)))
    possible = F.col(key).isNotNull() & F.coalesce(F.col(mask).bitwiseAND(F.col(own)) == F.col(own), F.lit(False))
    hits = probed.where(possible).join(listing.select(F.col("key").alias(known)), F.col(key) == F.col(known), "left")
    # the url columns are read twice so that only possible hits are ever shuffled
    return hits.select(*df.columns, F.col(known).isNotNull().alias(to)).union(probed.where(~possible).select(*df.columns, F.lit(False).alias(to)))


RESULTS = ("host", "path", "rule", "verdict")


def judge_urls(spark: SparkSession, df: DataFrame, listing: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """df with host, path, rule and verdict; listing: blocked URLs, one column url."""
    passed = [c for c in df.columns if c.lower() not in RESULTS or c == url]
    key, hit, rule, h, p = fresh(df.withColumns({c: F.lit(0) for c in RESULTS}), "canonical_url", "is_listed", "fitting_rule", "own_host", "own_path")
    shown = df.select(*passed).withColumns({h: host(F.col(url)), p: path(F.col(url))}).withColumn(rule, fitting(F.col(h), F.col(p), rules))
    shown = shown.withColumn(key, F.when(F.col(rule).isNull(), canonical(F.col(url), F.col(h), F.col(p))))
    keys = listing.select(canonical(F.col("url"), host(F.col("url")), path(F.col("url"))).alias("key"))
    found = listed(spark, shown, key, keys, hit)
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(hit), "block").otherwise("allow"))
    results = {"host": F.col(h), "path": F.col(p), "rule": F.col(f"{rule}.rule"), "verdict": verdict}
    return found.select(*(c for c in passed if c.lower() not in RESULTS), *(c.alias(k) for k, c in results.items()))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; listed are the canonical URLs of pages on spam hosts or brought in by a campaign."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listing = pages.where(host(F.col("url")).rlike(SPAM) | F.col("url").rlike(CAMPAIGN)).select("url")
    return judge_urls(spark, pages, listing).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query FROM u),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS key FROM q),
l AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '(^|\.)(spam-farm|free-bets|casino-win)\.') OR regexp_matches(url, '[?&]utm_source=')),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(v, h, p)),
j AS (
  SELECT page_id, host, path, key,
    (SELECT max_by(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT max_by(v, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS v
  FROM k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN l ON j.key = l.key
"""

QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": OP8_SQL}
