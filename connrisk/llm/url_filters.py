"""URL filters: rules, and link-graph propagation for the hosts they leave open.

Method: links of the pages become weighted edges between hosts.  Trust is a
personalised PageRank that restarts at hosts whose pages the rules allow;
distrust is the same on reversed edges, restarting at hosts whose pages the
rules block (a page that links to bad hosts is suspect).  Both run in Spark on
one row per host and edge, with a checkpoint after every round.  A host whose
distrust exceeds ``threshold`` of its trust plus distrust is blocked; a host
that neither reaches keeps ``default``.  The rounds go on until no host's score
changes by more than ``TOLERANCE`` of itself, however far it is from the seeds.

A page's verdict is that of the longest rule that fits its url, else its
host's.  A rule ``host/path`` fits the host and all its subdomains when the
url's path starts with ``/path``.  Rules are expanded by the driver into a
literal condition; their number is that of a configuration file.

Pages are reduced to host edges by a partial count in each task before any
shuffle, so a host with a third of all pages costs one row per task and target.

Defined cases
-------------
* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
  lower-cased; path: from there up to ``?``, ``#`` or the end; a null url or
  one without ``://`` has an empty host and path, fits no rule and gets the
  default verdict;
* links: href values with ``scheme://host`` or ``//host``; relative ones and
  those to the page's own host say nothing about it and make no edge, nor do
  other schemes (``mailto:``); null html has no links;
* no seeds, no links or an empty table: all scores 0, default verdicts;
* repeated rows stay, each with its verdict, and count in the edge weights;
  extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connrisk.llm.common import spread_scan, start, stored

ALLOW, BLOCK = "allow", "block"
#: Share of a host's score that follows links, the part of a score that may still change at the end, and the part of
#: distrust from which a host is blocked.
DAMPING = 0.85
TOLERANCE = 1e-6
THRESHOLD = 0.5
#: So many rounds bring the changes of all scores together below the tolerance; no cap.
ROUNDS = math.ceil(math.log(TOLERANCE / 4) / math.log(DAMPING))
#: Scores below are rounding noise of products of many shares.
_LEAST = 1e-290

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: F.Column) -> F.Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """``(rule, verdict)`` of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, path_start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + path_start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(page_id, host, path, rule, ruled)`` of every page."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: how many links of pages on ``src`` go to ``dst``."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""), F.lit(1))
    kinds = F.transform(hrefs, lambda x: F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x))
    linked = F.transform(
        F.filter(kinds, lambda x: ~x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)")),
        lambda x: F.when(F.locate("://", x) > 0, host_of(x)).otherwise(F.col("src")))
    # A page's own targets are counted before they leave its row.
    links = pages.select(host_of(F.col("url")).alias("src"), "html").select("src", F.explode(linked).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_rank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
                      tolerance: float = TOLERANCE) -> DataFrame:
    """``(kind, host, score)`` after PageRank with restarts, one graph for each ``kind``.

    ``nodes`` holds ``(kind, host, seed)`` once per host; the seeds of a kind
    sum to 1 or are all 0.  A host without links out gives its score back to
    the seeds.  It ends when no score changes by more than ``tolerance`` of
    itself, so not before every host that links lead to has its score, or
    after ``rounds`` where they are given.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = stored(edges.join(out, ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share")))
    leads = out.select("kind", F.col("src").alias("host"), F.lit(True).alias("leads"))
    rank = stored(nodes.join(leads, ["kind", "host"], "left").select(
        "kind", "host", "seed", F.coalesce("leads", F.lit(False)).alias("leads"), F.col("seed").alias("score")))
    done = 0
    while rounds is None or done < rounds:
        done += 1
        lost = rank.where("not leads").groupBy("kind").agg(F.sum("score").alias("lost"))  # one row for each kind
        got = shares.join(rank.select("kind", "host", "score"), ["kind", "host"]).groupBy(
            "kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        back = F.coalesce("lost", F.lit(0.0)) * F.col("seed")
        rank = stored(rank.join(got, ["kind", "host"], "left").join(F.broadcast(lost), "kind", "left").select(
            "kind", "host", "seed", "leads", F.col("score").alias("old"),
            ((1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + back)).alias("score")))
        largest = F.greatest("score", "old")
        if not rank.where((largest > _LEAST) & (F.abs(F.col("score") - F.col("old")) > tolerance * largest)).limit(1).count():
            break
    return rank.select("kind", "host", "score")


def host_scores(ruled: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """``(host, trust, distrust)`` for each host with pages or links.

    A host is a trusted seed when the rules allow more than half of its pages
    and a blocked seed when they block more than half.
    """
    mine = ruled.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("ruled") == ALLOW, 1)).alias("allowed"),
        F.count(F.when(F.col("ruled") == BLOCK, 1)).alias("blocked"), F.count("*").alias("n"))
    linked = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    seed = lambda column: F.coalesce(F.col(column) * 2 > F.col("n"), F.lit(False))
    both = mine.join(linked, "host", "full").select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), seed("allowed").alias("is_seed")),
        F.struct(F.lit("distrust").alias("kind"), seed("blocked").alias("is_seed")))))
    hosts = stored(both)
    sums = hosts.where("is_seed").groupBy("kind").agg(F.count("*").alias("all"))
    nodes = hosts.join(F.broadcast(sums), "kind", "left").select(
        "kind", "host", F.when(F.col("is_seed"), 1.0 / F.col("all")).otherwise(0.0).alias("seed"))
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    score = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return personalised_rank(nodes, ways, damping, rounds).groupBy("host").agg(score("trust"), score("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD, default: str = ALLOW,
          damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every page."""
    start(pages.sparkSession)
    rows = spread_scan(pages.select("page_id", "url", "html"))
    ruled = with_rules(rows, rules)
    edges = stored(host_edges(rows))
    scores = host_scores(ruled, edges, damping, rounds)
    bad = scores.where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host")
    # A host with many pages is a hot key of this join on the left, which AQE splits; each host is one row on the right.
    judged = ruled.join(bad.withColumn("bad", F.lit(True)), "host", "left")
    method = F.when(F.col("bad"), BLOCK).otherwise(default)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))
