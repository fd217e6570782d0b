"""URL rules that also hold for a page's aliases (redirects and canonical links)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, saved
from tracewell.llm.components import connected_components

RULES_SCHEMA = "rule_host string, rule_path string, action string"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A page's name in the alias graph: host, path and query, without scheme and fragment. Null where there is no ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def aliases(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of the canonical link and of the redirect (a meta refresh, after any delay) that each page's html states. Relative targets are put behind the folder of the page as they stand; dots in them are not resolved."""
    attr = lambda tag, name: F.coalesce(
        *(F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{quoted}", 1), F.lit("")) for quoted in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)"))
    )
    canonical = F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract("html", r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    target = F.regexp_extract(attr(refresh, "content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    found = (
        pages.where(F.col("html").ilike("%canonical%") | F.col("html").ilike("%http-equiv%"))
        .select("url", F.explode(F.array(attr(canonical, "href"), target)).alias("to"))
        .select("url", F.trim(F.regexp_replace("to", "&amp;", "&")).alias("to"))
        .where("to <> '' and contains(url, '://')")
    )
    origin = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    to = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(origin, "to"))
        .when(~F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), "to"))
    )
    return found.select(F.col("url").alias("from_url"), to.alias("to_url")).where("to_url is not null")


def matched_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action): the longest rule that fits, of the distinct (host, path) in `sites`.

    A host is looked up with each of its parent domains, an equality join that Spark broadcasts only
    after it has seen that the rules are small. A rule for host and path is longest by its host, then its
    path; block comes before allow where one rule is given both ways.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = F.concat("rule_host", "rule_path")
    return (
        sites.select("host", "path", F.explode(parents).alias("rule_host"))
        .join(rules.select(*(ascii_lower(F.col(c)).alias(c) if c == "rule_host" else c for c in ("rule_host", "rule_path", "action"))), "rule_host")
        .where(F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule_host").alias("a"), F.length("rule_path").alias("b"), F.col("action").alias("action"), rule.alias("rule"))).alias("best"))
        .select("host", "path", "best.rule", "best.action")
    )


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Each row of `pages` (url, html and any other columns) with host, path, rule and verdict.

    verdict: the action of the longest rule that fits the page's own url. Where none fits, the page takes
    the decision of its aliases, the pages that canonical links and redirects join to it: allow if a
    rule allows one of them, else block if a rule blocks one, else allow. Aliases that have no page
    of their own count too. redirects: further (from_url, to_url) rows, as from a crawl log.

    Null urls and urls without :// have an empty host and path, no rule and no alias: allow. Null html has
    no links. Repeated rows stay repeated; other columns pass through. A name that is already taken
    (host, path, rule, verdict) is replaced.
    """
    base = pages.drop("host", "path", "rule", "verdict")
    url = F.col("url")
    # a page without a node meets no alias; such pages are dealt out
    node = F.coalesce(node_of(url), F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 1024).cast("string")))
    own = base.select(F.struct(*base.columns).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"), node.alias("node"))
    edges = aliases(pages) if redirects is None else aliases(pages).unionByName(redirects.select("from_url", "to_url"))
    edges = saved(edges.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"), "from_url", "to_url").dropna(), "aliases")
    ends = edges.select(F.col("from_url").alias("url")).unionByName(edges.select(F.col("to_url").alias("url")))
    ends = ends.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")).distinct()
    component = connected_components(edges.select("a", "b"))
    decided = (
        ends.join(matched_rules(ends.select("host", "path").distinct(), rules), ["host", "path"])
        .join(component, "node")
        .groupBy("component")
        .agg(F.when(F.bool_or(F.col("action") == "allow"), "allow").otherwise("block").alias("of_aliases"))
    )
    passed = component.join(decided, "component").select("node", "of_aliases")
    fits = matched_rules(own.select("host", "path").distinct(), rules)
    verdict = F.coalesce("action", "of_aliases", F.lit("allow")).alias("verdict")
    return own.join(fits, ["host", "path"], "left").join(passed, "node", "left").select("page.*", "host", "path", "rule", verdict)
