"""URL filters: host rules first, then trust and distrust that spread over links between hosts.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are
distrusted seeds, each in proportion to such pages.  Personalised PageRank carries
trust along links and distrust against them (who links to a blocked host is suspect).
A host is blocked when its distrust outweighs its trust.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.session import write_once


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def read(cls, verdict: str, text: str) -> Rule:
        """A rule from its string: the host up to the first slash, then the path."""
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule.read("allow", "org/"),
    Rule.read("block", "example.org/es/"),
    Rule.read("block", "example.org/en/1"),
    Rule.read("allow", "com/fr/"),
    Rule.read("block", "com/de/"),
)

#: Share of a host's score that it passes on.
DAMPING = 0.85
#: Trust and distrust that may still move in a round, of a total of 1 each, when spreading ends.
TOLERANCE = 1e-6
#: Distrust over trust beyond which a host is blocked.
THRESHOLD = 1.0

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    return F.coalesce(_host(_rest(url)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    below = F.endswith(host, F.lit("." + rule.host))
    return ((host == rule.host) | below) & F.startswith(path, F.lit(rule.path))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of its string and verdict; null without one.

    Rules are part of the plan, so they are meant to be few (hundreds).
    """
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    named = [F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in ordered]
    cases = [F.when(_fits(r, host, path), n) for r, n in zip(ordered, named)]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path and the rule that fits each page's url."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("fit", longest_rule(rules, F.col("host"), F.col("path"))).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """``(source, target, links)`` between different hosts, from the href attributes of the pages.

    A reference without a host of its own stays on its page's host and is no link
    between hosts.
    """
    quoted = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]*//[^"'\s>]*)"""), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("source"), F.explode(quoted).alias("href"))
    absolute = F.when(F.startswith("href", F.lit("//")), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    outside = F.rlike("href", F.lit(r"^(?i)([a-z][a-z0-9+.-]*:)?//"))
    links = found.filter(outside).select("source", host_of(absolute).alias("target"))
    apart = (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    return links.filter(apart).groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def _seeds(judged: DataFrame) -> DataFrame:
    """Every host with pages, and the share of all allowed (trust) and blocked (distrust) pages that it has."""
    hosts = judged.filter(F.col("host") != "").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")
    )
    totals = F.lit(
        hosts.agg(
            F.greatest(F.sum("allowed"), F.lit(1)).alias("allowed"), F.greatest(F.sum("blocked"), F.lit(1)).alias("blocked")
        ).select(F.struct("*")).scalar()
    )
    return hosts.select(
        "host",
        (F.col("allowed") / totals["allowed"]).alias("trust_seed"),
        (F.col("blocked") / totals["blocked"]).alias("distrust_seed"),
    )


def most_rounds(tolerance: float = TOLERANCE, damping: float = DAMPING) -> int:
    """Rounds after which the scores have settled, whatever the links.

    The links pass on no more than ``damping`` of what moved in the round before, and
    scores start as the share of the seeds that stays, ``1 - damping`` of each kind.
    """
    if not 0 < damping < 1 or tolerance <= 0:
        raise ValueError(f"damping is between 0 and 1 and the tolerance positive, got {damping} and {tolerance}")
    return max(1, math.ceil(math.log(tolerance / (2 * (1 - damping))) / math.log(damping)) + 1)


def spread(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)`` by personalised PageRank in both directions, spread until it settles.

    Each link carries its share of its host's links: of those going out for trust,
    of those coming in for distrust.  A round joins the links, written once in both
    directions, with the scores and adds up by host, combined before the shuffle;
    a host's own row of the round before comes along and tells how far it moved.
    Rounds end when the summed change is ``tolerance`` or less, and it is an error
    if that takes longer than ``most_rounds``.
    """
    out = links.groupBy(F.col("source").alias("from")).agg(F.sum("links").alias("out_links"))
    into = links.groupBy(F.col("target").alias("to")).agg(F.sum("links").alias("in_links"))
    shares = links.join(out, F.col("source") == F.col("from")).join(into, F.col("target") == F.col("to"))
    none = F.lit(0.0)
    both = F.array(
        F.struct(F.col("source").alias("at"), F.col("target").alias("next"),
                 (F.col("links") / F.col("out_links")).alias("onward"), none.alias("backward")),
        F.struct(F.col("target").alias("at"), F.col("source").alias("next"),
                 none.alias("onward"), (F.col("links") / F.col("in_links")).alias("backward")),
    )
    steps = write_once(shares.select(F.inline(both)), "host-links")
    linked = steps.select(F.col("at").alias("host")).distinct()
    scores = write_once(
        seeds.join(linked, "host", "full")
        .na.fill(0.0, ["trust_seed", "distrust_seed"])
        .select(
            "*", *[((1 - damping) * F.col(f"{kind}_seed")).alias(kind) for kind in ("trust", "distrust")]
        ),
        "host-scores",
    )
    if steps.isEmpty():
        return scores.select("host", "trust", "distrust")
    known = ["trust_seed", "distrust_seed", "trust", "distrust"]
    for _ in range(most_rounds(tolerance, damping)):
        passed = steps.join(scores, F.col("at") == F.col("host")).select(
            F.col("next").alias("host"), *[F.lit(None).cast("double").alias(c) for c in known],
            (F.col("onward") * F.col("trust")).alias("trust_in"), (F.col("backward") * F.col("distrust")).alias("distrust_in"),
        )
        own = scores.select("host", *known, none.alias("trust_in"), none.alias("distrust_in"))
        received = passed.union(own).groupBy("host").agg(
            *[F.max(c).alias(c) for c in known], F.sum("trust_in").alias("trust_in"), F.sum("distrust_in").alias("distrust_in")
        )
        trust = (1 - damping) * F.col("trust_seed") + damping * F.col("trust_in")
        distrust = (1 - damping) * F.col("distrust_seed") + damping * F.col("distrust_in")
        moved = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        after = received.select(
            "host", "trust_seed", "distrust_seed", trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved")
        )
        written = write_once(after, "host-scores")
        scores = written.drop("moved")
        if written.agg(F.sum("moved")).first()[0] <= tolerance:
            return scores.select("host", "trust", "distrust")
    raise RuntimeError("trust and distrust have not settled")


def filtered(
    pages: DataFrame, rules: Sequence[Rule] = RULES, tolerance: float = TOLERANCE, threshold: float = THRESHOLD
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for every page.

    The verdict is the rule's where one fits, else the host's: ``block`` if distrust
    exceeds ``threshold`` times trust.  Without a host (a null url, or none with
    ``://``) host and path are empty and the page is allowed.
    """
    judged = write_once(ruled(pages, rules), "ruled-pages")
    scores = spread(_seeds(judged), host_links(pages), tolerance)
    scored = write_once(scores.withColumnRenamed("host", "scored"), "host-trust")
    joined = judged.join(scored, F.col("host") == F.col("scored"), "left").na.fill(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust"
    )


def digest(pages: DataFrame) -> DataFrame:
    return filtered(pages).select("page_id", "host", "path", "rule", "verdict")


def sql(rounds: int = most_rounds()) -> str:
    """The same in SQL, for as many rounds as any links can need."""
    return (
        r"""
WITH RECURSIVE rests AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rests),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
ruled AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM judged),
hrefs AS (
  SELECT host AS source, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*//[^"''\s>]*)', 1)) AS href FROM parts),
absolute AS (
  SELECT source, CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS href
  FROM hrefs WHERE regexp_matches(href, '^(?i)([a-z][a-z0-9+.-]*:)?//')),
targets AS (
  SELECT source, translate(regexp_extract(substr(href, instr(href, '://') + 3), '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM absolute),
links AS (
  SELECT source, target, count(*) AS n FROM targets
  WHERE source <> '' AND target <> '' AND source <> target GROUP BY source, target),
shares AS (
  SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS onward, n / sum(n) OVER (PARTITION BY target) AS backward
  FROM links),
hosts AS (
  SELECT host, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b
  FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (
  SELECT host, a / greatest((SELECT sum(a) FROM hosts), 1) AS trust_seed, b / greatest((SELECT sum(b) FROM hosts), 1) AS distrust_seed
  FROM hosts),
base AS (
  SELECT host, coalesce(trust_seed, 0.0) AS trust_seed, coalesce(distrust_seed, 0.0) AS distrust_seed
  FROM seeds FULL JOIN (SELECT source AS host FROM shares UNION SELECT target FROM shares) USING (host)),
steps AS (
  SELECT source AS here, target AS next, onward, 0.0 AS backward FROM shares
  UNION ALL SELECT target, source, 0.0, backward FROM shares
  UNION ALL SELECT host, host, 0.0, 0.0 FROM base),
"""
        + f"""
scores AS (
  SELECT 0 AS round, host, 0.15 * trust_seed AS trust, 0.15 * distrust_seed AS distrust FROM base
  UNION ALL
  SELECT round + 1, b.host, 0.15 * any_value(trust_seed) + 0.85 * sum(onward * trust),
    0.15 * any_value(distrust_seed) + 0.85 * sum(backward * distrust)
  FROM scores s JOIN steps ON s.host = here JOIN base b ON b.host = next
  WHERE round < {rounds} GROUP BY round, b.host)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN (SELECT * FROM scores WHERE round = {rounds}) USING (host)
"""
    )
