"""URL filter: block decisions spread over redirect and canonical-link equivalence, explicit allows first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .graph import connected_components

#: (verdict, host, start of path). A rule list is a parameter of at most some hundred rules: it becomes one expression.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that name no other page.
TRACKING = r"(?i)\A(?:utm_[a-z]+|ref|fbclid|gclid)="


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case. Path: from there up to ? # or the end. Empty without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Of equally long ones the first in the list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_key(url: Column) -> Column:
    """One name for addresses that servers redirect to each other as a matter of course.

    Scheme, www. and m. hosts, default ports, fragments, tracking and empty parameters and a last slash don't count. Null without ://.
    """
    host, path = host_path(url)
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    name = F.regexp_replace(F.regexp_replace(host, r"\A(?:www|m)\.", ""), r":(?:80|443)\z", "")
    return F.when(F.locate("://", url) > 0, F.md5(F.concat(name, F.lit("\n"), F.regexp_replace(path, r"/+\z", ""), F.lit("\n"), query).cast("binary")))


def resolved(target: Column, base: Column) -> Column:
    """An absolute address of a link on a page."""
    scheme, site = F.regexp_extract(base, r"\A([^:/?#]+)://", 1), F.regexp_extract(base, r"\A([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"\A([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("#") | (target == ""), base)
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"\A([^?#]*)", 1), target))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def links(html: Column) -> Column:
    """Targets that a page itself declares: its canonical link and its refresh redirect."""
    canonical = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    decoded = lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))
    return F.filter(F.array(decoded(canonical), decoded(refresh)), lambda x: x != "")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html).

    A page under a rule has that rule's verdict. Others share one verdict with all addresses they are equivalent to: allow
    where one of those is explicitly allowed, else block where one is blocked, else allow. Null or malformed urls, and null html,
    have no equivalents. Repeated rows are judged each.
    """
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), alias_key(F.col("url")).alias("node"))
    own = own.withColumn("match", matched(F.col("host"), F.col("path"), rules))
    found = written(own.select("page_id", "host", "path", "node", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("own"), "url", links(F.col("html")).alias("links")), "urls")
    targets = found.where("node is not null AND size(links) > 0").select("node", "url", F.explode("links").alias("link")).select("node", resolved(F.col("link"), F.col("url")).alias("target"))
    host, path = host_path(F.col("target"))
    edges = targets.select("node", alias_key(F.col("target")).alias("to"), matched(host, path, rules)["verdict"].alias("own")).where("`to` is not null")
    edges = written(edges.distinct(), "url-links")
    parts = connected_components(edges.select(F.col("node").alias("a"), F.col("to").alias("b")))
    said = found.select("node", "own").unionByName(edges.select(F.col("to").alias("node"), "own")).where("node is not null AND own is not null").distinct()
    said = said.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("class")).agg(F.max(F.col("own") == "allow").alias("allowed"))
    classed = found.join(parts, "node", "left").withColumn("class", F.coalesce("component", "node"))
    verdict = F.coalesce("own", F.when(~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow")))
    return classed.join(said, "class", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: The given pages declare no canonical links or redirects; their spreading is tested against brute force.
ORACLE = r"""
WITH split AS (
  SELECT page_id, url, strpos(url, '://') AS sep FROM pages),
parts AS (
  SELECT page_id, url,
         CASE WHEN coalesce(sep, 0) > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*') ELSE '' END AS raw_host,
         CASE WHEN coalesce(sep, 0) > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN sep > 0 THEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) END AS query
  FROM split),
named AS (
  SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
ruled AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
         CASE WHEN query IS NOT NULL THEN
           regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || chr(10) || regexp_replace(path, '/+$', '') || chr(10) ||
           array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=', 'i')), '&') END AS node
  FROM named),
said AS (
  SELECT node, bool_or(rule IN ('example.net/en/', 'org/fr/')) AS allowed FROM ruled WHERE rule IS NOT NULL AND node IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN NOT allowed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN said USING (node)
"""
