"""URL filter: a blocked Bloom filter passes possible hits on to an exact hash join. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.llm.bloom import blocks_for, bloom_words, might_contain
from tracelark.llm.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Lower-cased text between the first ``://`` and ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """Without user information, a default port or dots at the end: one form for hosts that are the same."""
    return F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), "[.]*(:(80|443)?)?$", "")


def canonical_path(path: Column) -> Column:
    """A slash for an empty path, and percent codes in capitals (``%c3%a9`` and ``%C3%A9`` are one)."""
    pieces = F.split(path, "%")
    coded = F.transform(pieces, lambda p, i: F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substr(p, F.lit(1), F.lit(2))), F.substr(p, F.lit(3)))).otherwise(p))
    return F.when(path == "", "/").otherwise(F.array_join(coded, "%"))


def _key(host: Column, path: Column) -> Column:
    return F.concat(canonical_host(host), F.lit("\n"), canonical_path(path))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, default: str = "allow") -> DataFrame:
    """Judge ``pages`` (page_id, url) by rules and by a list of canonical URLs.

    ``rules`` holds (action, host, path prefix) and is a short parameter; ``listed`` has columns host and path,
    any size, repeats allowed. A rule fits its host and all subdomains where the path starts with the rule's;
    the longest wins. Without a rule, a listed URL is blocked and any other gets ``default``.

    Rules are judged as column expressions in the scan. Pages that none fits are tested against the Bloom filter of
    the list's canonical URLs, in the scan too; only possible hits are shuffled, by URL and page, into the exact join,
    which drops false positives. A URL that very many pages have is one of the list's keys at most, so Spark splits it.

    The list is compared by ``canonical_host`` and ``canonical_path``; host and path are returned as they stand.

    Null or odd urls give empty host and path and no rule. Repeated rows stay as they are, null ids too; an
    empty table gives an empty result; columns beyond page_id and url are ignored.

    Returns page_id, host, path, rule, verdict.
    """
    list_keys = listed.select(_key(F.col("host"), F.col("path")).alias("key")).where("key is not null and host != ''").distinct()
    list_keys = written(list_keys, "listed-urls")
    blocks = blocks_for(list_keys.count())
    words = bloom_words(list_keys, blocks).scalar()

    seen = pages.select("page_id", F.col("url").cast("string").alias("url"))
    seen = seen.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # Longest first; of equally long ones the greatest.
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for action, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        best = F.when(fits, F.struct(F.lit(f"{host}{path}").alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    ruled = seen.withColumn("best", best).withColumn("key", F.when(F.col("best").isNull() & (F.col("host") != ""), _key(F.col("host"), F.col("path"))))
    tested = ruled.withColumn("hit", F.coalesce(might_contain(words, F.col("key"), blocks), F.lit(False)))
    calm = tested.where("not hit").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    exact = tested.where("hit").join(list_keys.withColumn("listed", F.lit(True)), "key", "left")
    rest = exact.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("listed"), "block").otherwise(default).alias("verdict"))
    return calm.unionByName(rest)


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def tracked_urls(pages: DataFrame) -> DataFrame:
    """The list used by the query: URLs that some crawl reached through a tracking parameter."""
    tagged = pages.select(F.col("url").cast("string").alias("url")).where(F.col("url").contains("utm_"))
    return tagged.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).where("host != ''").distinct()


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages``, by RULES and by the list of tracked URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, tracked_urls(pages))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE
      translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE
      regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
keyed AS (SELECT *,
  regexp_replace(regexp_replace(host, '^[^@]*@', ''), '[.]*(:(80|443)?)?$', '') AS khost,
  CASE WHEN path = '' THEN '/' ELSE array_to_string(list_transform(string_split(path, '%'), lambda p, i:
    CASE WHEN i > 1 AND regexp_matches(p, '^[0-9A-Fa-f]{2}') THEN upper(p[1:2]) || p[3:] ELSE p END), '%') END AS kpath
  FROM parts),
listed AS (SELECT DISTINCT khost, kpath FROM keyed WHERE contains(url, 'utm_') AND host <> ''),
best AS (
  SELECT p.*, (SELECT max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, action := action)) FROM rules
    WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS b
  FROM keyed p)
SELECT page_id, host, path, b.rule AS rule,
  coalesce(b.action, CASE WHEN host <> '' AND (khost, kpath) IN (SELECT (khost, kpath) FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
