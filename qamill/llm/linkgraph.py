"""URL filter: rules first, then trust and distrust propagated over the link graph of hosts.

Trust is personalised PageRank from the hosts that hold allowed pages; distrust is the same walk
over the reversed edges from the hosts that hold blocked pages (who links to a bad host is
suspect). Each host's share ``distrust / (trust + distrust + prior)`` is compared with a threshold.

Edges come from absolute and protocol-relative links in the pages; links within a host say
nothing about another one and are left out. Rank that reaches a host without links ends there.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qamill.session import materialise

#: (verdict, host, path); a rule is written as host + path.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.substring_index(_after(url), "/", 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, F.lit(domain + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, counted per pair."""
    found = pages.select(
        url_host(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER))
    found = found.where((F.col("src") != "") & (F.col("src") != F.col("dst")))
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(
    seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, settled: float = 1e-6,
) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust) over ``edges`` (src, dst, links).

    Both walks are one table keyed by (host, walk), so a round is one join and one aggregation.
    Every round is written to the shared folder: the plan stays short and a lost executor costs
    one round. Stops once all the changes still to come sum up to ``settled`` at most, so no score is
    further off, or once double precision brings the changes down no more (or after ``rounds``, if
    given). Changes shrink by ``damping`` a round: the rounds grow with the logarithm of the seeds.
    Without edges or seeds the scores are the seeds' own share.
    """
    out = F.sum("links").over
    forward = edges.select(F.lit(0).alias("walk"), "src", "dst",
                           (F.col("links") / out(W.partitionBy("src"))).alias("share"))
    backward = edges.select(F.lit(1).alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"),
                            (F.col("links") / out(W.partitionBy("dst"))).alias("share"))
    moves = materialise(forward.unionByName(backward), "moves")
    start = materialise(seeds.select(
        F.col("host").alias("src"),
        F.explode(F.array(F.struct(F.lit(0).alias("walk"), F.col("trust").alias("seed")),
                          F.struct(F.lit(1).alias("walk"), F.col("distrust").alias("seed")))).alias("s"),
    ).select("src", "s.walk", (F.col("s.seed") * (1 - damping)).alias("seed")).where("seed > 0"), "seeds")
    state = start.select("src", "walk", F.col("seed").alias("score"), F.col("seed").alias("was"))
    if start.limit(1).count() and moves.limit(1).count():
        last = float("inf")
        for _ in itertools.count() if rounds is None else range(rounds):
            sent = state.where("score > 0").join(moves, ["src", "walk"]).select(
                F.col("dst").alias("src"), "walk", (F.col("score") * F.col("share") * damping).alias("add"),
                F.lit(0.0).alias("was"))
            base = start.select("src", "walk", F.col("seed").alias("add"), F.lit(0.0).alias("was"))
            old = state.select("src", "walk", F.lit(0.0).alias("add"), F.col("score").alias("was"))
            state = materialise(sent.unionByName(base).unionByName(old).groupBy("src", "walk").agg(
                F.sum("add").alias("score"), F.sum("was").alias("was")), "ranks")
            moved = state.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
            if moved * damping <= settled * (1 - damping) or moved >= last:
                break
            last = moved
    of = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("score")).otherwise(0.0))
    return state.groupBy(F.col("src").alias("host")).agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge_pages(
    pages: DataFrame, rules=RULES, threshold: float = 0.75, prior: float = 3.0,
    damping: float = 0.85, rounds: int | None = None, settled: float = 1e-4,
) -> DataFrame:
    """page_id, host, path, rule, verdict, host_distrust of every page.

    The verdict is the rule's; without a rule a page is blocked if the distrust share of its host
    reaches ``threshold``; ``prior`` stands for so many undecided pages, so that a host is not judged
    by one or two. Scores are exact to ``settled`` times the prior. Hosts that no seed reaches have share 0 and are allowed, as are pages
    without a url. Repeated rows are judged one by one (and count as links and seeds one by one);
    other columns of ``pages`` are ignored; a null html has no links. Pages of a hot host are
    counted in each task before the shuffle, and joined with one row per host.
    """
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    based = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    based = based.withColumn("rule", rule).withColumn("_verdict", verdict)
    says = lambda v: F.sum(F.when(F.col("_verdict") == v, 1.0).otherwise(0.0))
    seeds = based.where("host <> '' AND _verdict IS NOT NULL").groupBy("host").agg(
        says("allow").alias("trust"), says("block").alias("distrust"))
    scores = propagate(seeds, host_edges(pages), damping, rounds, settled * prior * (1 - damping))
    # a seed page's own share of rank is 1 - damping
    known = F.col("trust") + F.col("distrust") + F.lit(prior * (1 - damping))
    scores = scores.select(F.col("host").alias("_host"), (F.col("distrust") / known).alias("host_distrust"))
    joined = based.join(scores, F.col("host") == F.col("_host"), "left")
    distrust = F.coalesce("host_distrust", F.lit(0.0))
    learned = F.when(distrust >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule",
                         F.coalesce("_verdict", learned).alias("verdict"), distrust.alias("host_distrust"))
