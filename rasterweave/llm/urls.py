"""URL filter: host-suffix and path-prefix expressions against hashed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized_join

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (verdict, host, path prefix)
DEFAULT_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """Add host, path, rule and verdict to each row of ``pages``.

    ``rules`` has verdict, host, path. A rule fits its host and all subdomains
    when the url's path starts with the rule's path; the longest rule (host plus
    path) wins, then the longer host, then ``block``. Each distinct url becomes expressions
    ``host suffix + path prefix``, the prefixes cut at the lengths that rules
    have; expressions meet rules on the first ``prefix_hex`` digits of their
    SHA-256, then the full digest decides. Null urls and urls without ``://``
    have empty host and path and get ``default``; repeated rows each get their
    verdict; an empty rule table gives ``default`` everywhere. Columns of
    ``pages`` called host, path, rule or verdict are replaced.
    """
    rules = rules.where("host is not null and path is not null and host <> ''").select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_len"),
        F.length("path").alias("path_len"),
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, prefix_hex))
    rules = materialise(rules, "url-rules")
    lengths = [r[0] for r in rules.select("path_len").distinct().collect()]  # at most the longest path

    urls = pages.select(F.col(url).alias("__url")).where("__url is not null").distinct()
    parts = urls.select("__url", F.split(host_of(F.col("__url")), r"\.").alias("labels"), path_of(F.col("__url")).alias("__path"))
    suffixes = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels) - i + 1), '.'))")
    cuts = F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.expr("array()").cast("array<int>")
    expressions = (
        parts.select("__url", "__path", F.explode(suffixes).alias("suffix"))
        .where("suffix <> ''")
        .withColumn("cut", F.explode(cuts))
        .where("length(__path) >= cut")
        .select("__url", F.sha2(F.concat_ws("\n", "suffix", F.expr("substring(__path, 1, cut)")), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, prefix_hex))
    )
    hits = sized_join(expressions, rules, "short", "inner").where("digest = rule_digest")
    best = hits.groupBy("__url").agg(
        F.max(F.struct((F.col("host_len") + F.col("path_len")).alias("a"), F.col("host_len").alias("b"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("c"), "rule", "verdict")).alias("__best")
    )
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.select(*kept).join(best, F.col(url) == F.col("__url"), "left").select(
        *kept,
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def op6_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rules(v, h, p) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
                               ('allow','com','/fr/'), ('block','com','/de/')),
u AS (SELECT page_id, url,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
m AS (SELECT u.page_id, u.url, host, path, h || p AS rule, v,
        row_number() OVER (PARTITION BY u.page_id, u.url ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS rn
      FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE rn = 1
"""
