"""Allow and block rules on URLs, carried over redirects and canonical links. DataFrame work only.

A rule has a host and a path; it fits its host and all subdomains where the url's path starts with the rule's. The
longest rule that fits wins, and an allow rule wins over a block rule of the same length. A url without a rule of its
own takes the decision of its aliases: urls joined by meta refresh or canonical links form connected components, and a
component is allowed if any member has an explicit allow rule, else blocked if any member has a block rule, else
allowed. Members that are only linked to count, too.

Urls are one node when host (A-Z lower-cased), path (``/`` when empty) and query agree; scheme and fragment are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import staged
from promolift.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Rules are compared in every row, so their list is meant to be short.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def with_parts(frame: DataFrame, url: str) -> DataFrame:
    """Add host, path and node of the url column; all that follows the first ``://`` counts, nothing where it lacks.

    ``node`` is null without a host. Parts build on columns, not on repeated expressions, which keeps the plan small.
    """
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    start = F.instr(text, "://")
    rest = F.when(start > 0, F.substring(text, start + 3, F.length(text))).otherwise("")
    part = lambda pattern, group: F.regexp_extract("_rest", pattern, group)
    parts = frame.withColumn("_rest", rest).withColumns(
        {
            "host": F.translate(part("^[^/?#]*", 0), UPPER, LOWER),
            "path": part("^[^/?#]*([^?#]*)", 1),
            "_query": part("^[^?#]*([?][^#]*)", 1),
        }
    )
    shown = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    node = F.when(F.col("host") != "", F.concat("host", shown, "_query"))
    return parts.withColumn("node", node).drop("_rest", "_query")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The winning rule as a struct (rule, verdict); null where none fits."""
    ranked = sorted(rules, key=lambda rule: (-len(rule.host + rule.path), rule.verdict != "allow", rule))
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in reversed(ranked):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        own = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, own).otherwise(chosen)
    return chosen


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, without quotes; empty where there is none."""
    found = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.trim(F.translate(F.regexp_extract(tag, found, 1), "\"'", ""))


def alias_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(a, b): nodes joined by a meta refresh or a canonical link in a page's html."""
    tags = F.regexp_extract_all(F.col(html_column), F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    tag = F.col("tag")
    tagged = (
        pages.where(F.col(html_column).rlike("(?i)canonical|http-equiv"))
        .select(F.col(url_column).alias("url"), F.explode(tags).alias("tag"))
        .where(tag.rlike("(?i)canonical|refresh"))
        .select(
            "url",
            F.when(tag.rlike("(?i)^<link"), F.lower(_attribute(tag, "rel"))).alias("rel"),
            F.when(tag.rlike("(?i)^<meta"), F.lower(_attribute(tag, "http-equiv"))).alias("equiv"),
            _attribute(tag, "href").alias("href"),
            F.trim(F.regexp_extract(_attribute(tag, "content"), r"(?is)url\s*=\s*(.*)", 1)).alias("refresh"),
        )
    )
    target = F.when(F.col("rel") == "canonical", F.col("href")).when(F.col("equiv") == "refresh", F.col("refresh"))
    found = tagged.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target")).where("target <> ''")
    based = with_parts(found, "url").withColumnRenamed("node", "a").where("a is not null")
    folder = F.regexp_replace(F.when(F.col("path") == "", "/").otherwise(F.col("path")), "[^/]*$", "")
    there = (
        F.when(F.col("target").contains("://"), F.col("target"))
        .when(F.col("target").startswith("//"), F.concat(F.lit("http:"), "target"))
        .when(F.col("target").startswith("/"), F.concat(F.lit("http://"), "host", "target"))
        .otherwise(F.concat(F.lit("http://"), "host", folder, "target"))
    )
    ends = with_parts(based.select("a", there.alias("there")), "there")
    return ends.select("a", F.col("node").alias("b")).where("b is not null")


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    links: DataFrame | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and ``alias_verdict``, what the aliases say (null: nothing).

    ``links`` (a, b) replaces the links found in the html. A null url, or one without ``://``, has an empty host and
    path, fits no rule and is allowed. Repeated rows stay; other columns, whatever their names, are not read; an empty
    table gives an empty result.
    """
    edges = staged((alias_links(pages, url_column, html_column) if links is None else links).distinct(), "aliases")
    members = components(edges)
    placed = with_parts(members.select("component", F.concat(F.lit("http://"), "node").alias("_url")), "_url")
    decided = (
        placed.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)["verdict"])
        .groupBy("component")
        .agg(F.min("own").alias("alias_verdict"))  # "allow" < "block"
        .where("alias_verdict is not null")
    )
    decisions = members.join(decided, "component").select("node", "alias_verdict")
    seen = with_parts(pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("_url")), "_url")
    seen = seen.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return seen.join(decisions, "node", "left").select(
        "id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
        "alias_verdict",
    )
