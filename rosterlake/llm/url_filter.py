"""Operator 2: URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host and a path.  Each distinct URL is expanded into expressions:
the suffixes of its host with as many labels as some rule's host, with the prefixes of
its path as long as some rule's path, so that what a URL of any length costs follows
from the rules.  Expressions meet the rules in an equi-join on the first hex
digits of their SHA-256; the full digests then confirm the match, and of the
confirmed rules the longest decides.  Only built-in functions run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.support import materialize

#: Hex digits of a digest that the join compares.
SHORT = 8
#: Rules up to which their table is broadcast; longer lists are joined by shuffle.
BROADCAST_RULES = 100_000


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: str) -> Column:
    """From after the first :// to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """From the end of the host to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with url_host, url_path, url_rule (null where none fits) and url_verdict.

    A rule fits its host and all its subdomains if the path starts with the rule's.
    The longest rule (host and path together) wins, of equally long ones that with
    the longer host, then the first in code point order; of rules for the same host
    and path, block wins.  Without a rule the verdict is default.  A URL that is null
    or has no :// has an empty host and path.  A URL of any length, or with any number of
    labels, is judged whole, in time in proportion to its length.  Repeated rows are all returned; an
    empty table gives an empty result; columns of pages named url_host, url_path,
    url_rule and url_verdict are replaced.
    """
    spark = pages.sparkSession
    pages = pages.drop("url_host", "url_path", "url_rule", "url_verdict")
    listed = materialize(
        spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("full", _digest(F.concat_ws("\n", "rule_host", "rule_path")))
        .withColumn("short", F.substring("full", 1, SHORT)),
        "rules",
    )
    lengths = sorted({len(r.path) for r in rules}) or [0]
    parts = pages.select(F.col(url).alias("url")).where("url is not null").distinct()
    parts = parts.select("url", host_of("url").alias("host"), path_of("url").alias("path"))
    counts = sorted({r.host.count(".") + 1 for r in rules}) or [1]
    # A host with fewer labels gives itself, which fits no rule of that many labels.
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in counts]))
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths]), lambda p: p.isNotNull()
    )
    spread = parts.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    spread = spread.select("url", "suffix", F.explode("prefixes").alias("prefix"))
    spread = spread.select("url", _digest(F.concat_ws("\n", "suffix", "prefix")).alias("url_full"))
    spread = spread.withColumn("short", F.substring("url_full", 1, SHORT))
    side = F.broadcast(listed) if len(rules) <= BROADCAST_RULES else listed
    confirmed = spread.join(side, "short").where("url_full = full")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"), "verdict",
    )
    best = materialize(confirmed.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("ruled_url"), "best"), "ruled")
    return (
        pages.join(best, F.col(url) == F.col("ruled_url"), "left")
        .withColumns(
            {
                "url_host": host_of(url),
                "url_path": path_of(url),
                "url_rule": F.col("best.rule"),
                "url_verdict": F.coalesce("best.verdict", F.lit(default)),
            }
        )
        .drop("ruled_url", "best")
    )


def oracle_sql(rules: list[UrlRule], default: str = "allow") -> str:
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return rf"""
WITH rules(verdict, h, p) AS (VALUES {values}),
u AS (
  SELECT page_id, row_number() OVER () AS row_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)?', 1, 's') AS path
  FROM pages),
m AS (
  SELECT u.row_id, arg_max(struct_pack(r := h || p, v := verdict), length(h || p) * 1000 + length(h)) AS best
  FROM u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  GROUP BY u.row_id)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, '{default}') AS verdict
FROM u LEFT JOIN m ON u.row_id = m.row_id
"""
