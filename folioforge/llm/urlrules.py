"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules to test."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths with a prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path joined by a newline."""
        return rf"(?s)\A(.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has: the labels of the host, and the path's segments that end in a slash."""
        return [f"h:{t}" for t in self.host.split(".")] + [f"p:{t}" for t in self.path.split("/")[1:-1]]


#: The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DEFAULT = "allow"


def host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url):
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens(host_column, path_column):
    labels = F.transform(F.split(host_column, r"\."), lambda t: F.concat(F.lit("h:"), t))
    segments = F.transform(F.split(path_column, "/"), lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.concat(labels, segments))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT) -> DataFrame:
    """Columns of pages (url and any others), plus host, path, rule and verdict; columns of these names are replaced.

    Different URLs are judged once. Each rule stands in the index under the
    one of its tokens that fewest URLs hold; a URL's tokens fetch the rules
    listed under them, and only those run their patterns. The longest rule
    that fits wins, the last listed of equal rules; else rule is null and the
    verdict the default. Null URLs and URLs without ``://`` have empty host and
    path. URLs of any length and with line breaks are read whole; repeated rows
    each get theirs, and an empty table gives an empty one. Spark broadcasts
    the index while it is small and shuffles beyond.
    """
    spark = pages.sparkSession
    pages = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    urls = pages.select("url").where("url is not null").distinct().withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    held = urls.select("url", "host", "path", F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))

    listed = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, r.tokens) for i, r in enumerate(rules)], "position int, rule string, verdict string, pattern string, tokens array<string>"
    )
    spread = listed.withColumn("token", F.explode("tokens")).drop("tokens")
    often = held.join(spread.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = spread.join(often, "token", "left").groupBy("position").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "rule", "verdict", "pattern")).alias("r"))
    index = rarest.select("position", "r.token", "r.rule", "r.verdict", "r.pattern")

    fits = held.join(index, "token").where(F.expr("concat(host, '\n', path) rlike pattern"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("size"), "position", "rule", "verdict")).alias("b"))
    best = best.select("url", "b.rule", "b.verdict")
    told = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    # null URLs fit no rule: they stay out of the join, where they would meet in one task
    judged = told.where("url is not null").join(best, "url", "left").unionByName(told.where("url is null"), allowMissingColumns=True)
    return judged.select(*pages.columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages' URLs. Null URLs have empty parts and the default verdict; repeated rows each stay; no rows give none."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS place
         FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND place = 1
"""
