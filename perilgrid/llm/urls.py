"""URL filters with redirect equivalence.

Rules judge a page by host and path. Pages that no rule fits take the decision of their aliases: redirects (meta refresh)
and canonical links are edges between addresses, connected components over them are found in a distributed way, and a
component with a blocked address blocks its members unless a member is explicitly allowed.

Everything runs as column expressions; no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.runtime import Frozen
from perilgrid.operators.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict): a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none fits. The rules are configuration, a list
    of at most a thousand."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    fits = None
    for rule, verdict in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        name, _, start = rule.partition("/")
        here = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(here, value) if fits is None else fits.when(here, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _address(url: Column) -> Column:
    """What identifies an address: host, path and query; scheme, letter case of the host and fragment don't count."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/")), F.coalesce(query, F.lit("")))


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) for each page's canonical link and meta refresh; targets are resolved against the page."""
    page = F.coalesce(F.col(html), F.lit(""))
    canonical = F.regexp_extract(page, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    refresh = F.regexp_extract(page, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    href = F.regexp_extract(canonical, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    to = F.regexp_extract(refresh, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = (
        pages.filter(F.lower(page).contains("canonical") | F.lower(page).contains("http-equiv"))
        .select(F.col(url).alias("source"), F.explode(F.array(href, to)).alias("href"))
        .filter("href <> '' and instr(source, '://') > 0")
    )
    href = F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index("source", "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(F.col("source")))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(F.col("source")), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    target = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .otherwise(F.concat(site, folder, href))
    )
    return found.select("source", target.alias("target"))


def judge_urls(
    spark: SparkSession, pages: DataFrame, links: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """Judges every page: page_id, host, path, rule, verdict, component (an address, null without links).

    ``links`` has source and target addresses; by default the pages' own canonical links and redirects. A rule that fits
    the page decides. Else the page is blocked if its component holds an address that a rule blocks and none that a rule
    allows. Without rule and links a page is allowed. A null address, or one without ``://``, has empty host and path and
    is allowed. Repeated pages are judged alike, each with its own row; an empty table gives no rows; other columns are
    left out."""
    frozen = Frozen(spark, "urls")
    links = links_of(pages) if links is None else links
    edges = links.select(F.col("source"), F.col("target")).filter("source is not null and target is not null").distinct()
    edges = frozen(edges.withColumn("a", _address(F.col("source"))).withColumn("b", _address(F.col("target"))), "links")
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        judged = judged.select("*", F.lit(None).cast("string").alias("component"), F.lit(False).alias("bad"))
    else:
        known = connected_components(edges.select("a", "b"), frozen)
        ends = edges.select(F.col("source").alias("url"), F.col("a").alias("node")).unionAll(edges.select("target", "b"))
        fit = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
        ends = ends.select("node", fit.getField("verdict").alias("v")).filter("v is not null")
        worst = (
            ends.join(known, "node")
            .groupBy("root")
            .agg((F.bool_or(F.col("v") == "block") & ~F.bool_or(F.col("v") == "allow")).alias("bad"))
        )
        known = frozen(known.join(worst, "root", "left").select("node", F.col("root").alias("component"), "bad"), "known")
        judged = judged.join(known, _address(F.col("url")) == F.col("node"), "left")
    way = F.when(F.coalesce(F.col("bad"), F.lit(False)), "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), way).alias("verdict"),
        "component",
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` under the standing rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(spark, pages).select("page_id", "host", "path", "rule", "verdict", "component")


_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(rule, name, start, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT h.page_id, h.host, h.path, r.rule, r.v, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.name OR ends_with(h.host, '.' || r.name)) AND starts_with(h.path, r.start))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS component FROM f WHERE k = 1
"""
