"""URL filters that follow redirects: block decisions reach all aliases of a blocked address.

Redirects (``<meta http-equiv="refresh">``, and any table of them) and canonical links are edges
between addresses. Connected components of the edges are sets of aliases. An address that the rules
block blocks its component; an address that has a rule of its own keeps that rule's verdict, so an
explicit allow wins over a block that an alias brings. Everything else is allowed.

An address is host, path and query: scheme and fragment are left out, an empty path is ``/``. Links
without ``://`` are resolved against the page. All steps are DataFrame expressions and joins; only
pages with such links and their components are shuffled with more than one row for each page.

Null urls, and urls without ``://``, have an empty host and path, no rule and no aliases: allowed. Null html has
no links. Repeated rows are judged one by one. Of several rules that fit the longest wins, of equally
long ones the allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
Rule = tuple[str, str, str]

_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?is)\burl\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>;]+))"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query; null without ``://`` or without a host."""
    host, tail = host_of(url), F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(F.startswith(tail, F.lit("/")), F.lit("")).otherwise(F.lit("/")), tail))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, action) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule: string, action: string>")
    for action, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def _attribute(tag: Column, pattern: str) -> Column:
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def _resolved(links: DataFrame) -> DataFrame:
    """(url, target): the absolute form of each (url, link)."""
    url = F.col("url")
    parts = links.select(
        "url",
        F.replace("link", F.lit("&amp;"), F.lit("&")).alias("link"),
        F.regexp_extract(url, "(?s)^(.*?)://", 1).alias("scheme"),
        F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1).alias("site"),
        path_of(url).alias("path"),
    )
    link = F.col("link")
    folder = F.when(F.col("path") == "", F.lit("/")).otherwise(F.regexp_extract("path", "(?s)^(.*/)?", 0))
    return parts.select(
        "url",
        F.when(link.contains("://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat("scheme", F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat("site", link))
        .when(F.startswith(link, F.lit("?")), F.concat("site", "path", link))
        .when((link != "") & ~F.startswith(link, F.lit("#")), F.concat("site", folder, link))
        .alias("target"),
    )


def link_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): addresses joined by a canonical link, a refresh, or a row (from_url, to_url) of ``redirects``."""
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(_CANONICAL), 0), lambda t: _attribute(t, _HREF)),
        F.transform(F.regexp_extract_all("html", F.lit(_REFRESH), 0), lambda t: _attribute(F.replace(t, F.lit("&quot;"), F.lit('"')), _TARGET)),
    )
    # the tags are looked for only in pages that name them
    named = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    links = named.where(address(F.col("url")).isNotNull()).select("url", F.explode(tags).alias("link"))
    edges = _resolved(links).select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def blocked_addresses(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(address) of every node whose component has a node that the rules block."""
    nodes = components(edges)
    whole = F.concat(F.lit("://"), F.col("node"))
    own = nodes.withColumn("blocks", F.coalesce(rule_of(host_of(whole), path_of(whole), rules)["action"] == "block", F.lit(False)))
    roots = own.groupBy("root").agg(F.max("blocks").alias("blocks")).where("blocks").select("root")
    return nodes.join(roots, "root", "left_semi").select(F.col("node").alias("address"))


def verdicts(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    blocked = blocked_addresses(link_edges(pages, redirects), rules).select("address", F.lit(True).alias("blocked"))
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "address", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.action", F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )
