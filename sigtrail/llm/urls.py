"""URL filters: rules, and trust that spreads over links for hosts without one.

A rule names a host, with its subdomains, and the beginning of a path; the longest rule
that fits a URL decides it.  URLs that no rule fits are judged by their host: trust is
the personalised PageRank from hosts whose URLs rules allow, distrust is that of the
reversed links from hosts whose URLs rules block.  A host is blocked if most of what
links say of it is distrust: of all that reaches it from hosts that rules know, over
reversed links, and of the trust that reaches it, the share that comes from blocked
URLs.  A share doesn't sink where distrust is split over many hosts that link to one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.llm.scratch import as_row, drop, from_row, of_row, staged

DAMPING = 0.85
CHANGE = 5e-3
"""Propagation ends when a round changes ranks and masses by this share of the seeds."""
ROUNDS = 200
"""Rounds at most; each leaves DAMPING of the change before, so 33 reach ``CHANGE``."""
THRESHOLD = 0.5
"""Share of distrust in what reaches a host from which it is blocked."""

_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Block or allow ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as its place in the rules of that order; else null.

    Of rules of equal length the first in alphabetical order counts.
    """
    fitting = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(ordered(rules)))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        fitting = F.when(fits, i).otherwise(fitting)
    return fitting


def ordered(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name()), r.name()))


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target, weight): how many pages of a host link to another host."""
    found = pages.select(host_of(F.col(url)).alias("source"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), 1), lambda u: host_of(F.concat(F.lit("x:"), F.regexp_replace(u, r"^[^/]*:", "")))))).alias("target"))
    return found.where("source <> '' AND target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def _rank(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, least_change: float) -> DataFrame:
    """(host, rank, mass, known_mass): personalised PageRank in units of one full seed,
    and what reaches a host over all walks from the seeds, and from known hosts.

    ``edges`` has source, target and weight; ``seeds`` host, seed and known, 1 for a
    host that any rule knows.  A host without links gives the rank that it holds back to
    the seeds, so ranks always add up to the seeds; masses are damped only, so those of
    several seeds are the sums of each one's.  The sums of a host's incoming ranks are
    formed before they are shuffled.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    shares = staged(edges.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    rank = staged(seeds.select("host", F.col("seed").alias("rank"), F.col("seed").alias("mass"), F.col("known").alias("known_mass")))
    for _ in range(rounds if total and shares.limit(1).count() else 0):
        parts = [(F.sum(F.col(c) * F.col("share")) * damping).alias(c) for c in ("rank", "mass", "known_mass")]
        moved = staged(shares.join(rank, shares.source == rank.host).groupBy(F.col("target").alias("host")).agg(*parts))
        kept = moved.agg(F.sum("rank")).first()[0] or 0.0
        back = seeds.select("host", (F.col("seed") * (1 - kept / total)).alias("rank"), F.col("seed").alias("mass"), F.col("known").alias("known_mass"))
        new = staged(moved.union(back).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("rank", "mass", "known_mass")]))
        before = rank.select("host", *[F.col(c).alias(f"_{c}") for c in ("rank", "mass", "known_mass")])
        changes = [F.sum(F.abs(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"_{c}", F.lit(0.0)))) for c in ("rank", "mass", "known_mass")]
        change = sum(x or 0.0 for x in new.join(before, "host", "full").agg(*changes).first())
        drop(rank, moved)
        rank = new
        if change <= least_change * total:
            break
    drop(shares)
    return rank


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD, least_change: float = CHANGE) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``trust``, ``distrust`` and
    ``verdict``.

    A host seeds trust (distrust) by the share of its URLs that a rule allows (blocks).
    Links are absolute ``href``s to other hosts; a page counts once for each host it
    links to.  URLs without a host are in no graph and are allowed, as is every host
    that neither rules nor links reach.  Null and repeated rows are rows like others;
    columns of ``pages`` that are named like new ones are replaced.
    """
    named = as_row(pages).withColumn("host", host_of(of_row(url))).withColumn("path", path_of(of_row(url)))
    ruled = named.withColumn("_rule", rule_of(rules, F.col("host"), F.col("path")))
    best = ordered(rules)
    names = F.array(*[F.lit(r.name()) for r in best]) if best else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in best]) if best else F.array().cast("array<string>")
    ruled = ruled.withColumn("rule", F.get(names, F.col("_rule"))).withColumn("verdict", F.get(verdicts, F.col("_rule")))
    hosts = staged(ruled.where("host <> ''").groupBy("host").agg(*[F.avg(F.coalesce((F.col("verdict") == v).cast("double"), F.lit(0.0))).alias(v) for v in ("allow", "block")]))
    edges = staged(links(pages, url, html))
    scores = host_scores(hosts, edges, damping, rounds, least_change)
    drop(edges)
    blocked = F.coalesce(F.col("_against") > threshold * (F.col("_known") + F.col("_for")), F.lit(False))
    out = ruled.join(scores, "host", "left").withColumn("verdict", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow"))).fillna(0.0, ["trust", "distrust"])
    new = ("host", "path", "rule", "trust", "distrust", "verdict")
    return out.select(*from_row(pages, *new), *new)


def host_scores(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, least_change: float = CHANGE) -> DataFrame:
    """(host, trust, distrust, _for, _against, _known) of ``hosts``, which have the shares
    ``allow`` and ``block`` of their URLs; ``edges`` has source, target and weight."""
    known = F.lit(1.0).alias("known")
    seeds = hosts.where("allow > 0 OR block > 0")
    trust = _rank(edges, seeds.select("host", F.col("allow").alias("seed"), known), damping, rounds, least_change)
    reverse = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    distrust = _rank(reverse, seeds.select("host", F.col("block").alias("seed"), known), damping, rounds, least_change)
    trust = trust.select("host", F.col("rank").alias("trust"), F.col("mass").alias("_for"))
    distrust = distrust.select("host", F.col("rank").alias("distrust"), F.col("mass").alias("_against"), F.col("known_mass").alias("_known"))
    scores = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left")
    return staged(scores.fillna(0.0))
