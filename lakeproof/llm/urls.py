"""URL filters: rules by host and path, and trust spread over the link graph, in DataFrame functions only.

Personalised PageRank starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and
follows links backwards, to those who link to them. A host whose distrust outweighs its trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, materialize

#: (verdict, host and path) of the rules, a fixed value.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Link targets in a page: quoted or bare href values with a host. Valid for Java and RE2.
LINK = r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Propagation:
    """damping: share passed along links. rounds: least propagation steps; more follow until no host is new and no score moves by
    more than tolerance times itself. threshold: a host is blocked if its distrust is above threshold times its trust."""

    damping: float = 0.85
    rounds: int = 8
    threshold: float = 1.0
    tolerance: float = 1e-9


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a URL up to its query or fragment; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule whose host is the page's or above it and whose path starts the page's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts. Repeats within a page count once; hosts are counted before the shuffle."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(2)), lambda h: F.translate(h, UPPER, LOWER)))
    out = pages.select(F.col("host").alias("src"), F.explode(links).alias("dst")).filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return out.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, p: Propagation = Propagation()) -> DataFrame:
    """(kind, host, score) once settled, from edges (kind, src, dst, share) and seeds (kind, host, mass).

    score = (1 - damping) * mass + damping * sum of share * score of the sources. What a host without links would pass on is
    lost. Scores only grow, and a host that evidence reaches has a row however small its score. Each round is written, so a
    lost executor repeats one round only.
    """
    own = seeds.select("kind", "host", (F.col("mass") * (1 - p.damping)).alias("score"))
    own = materialize(own, "urls-own")
    now, rounds, moving = own, 0, not (own.isEmpty() or edges.isEmpty())
    none = F.lit(None).cast("double").alias("before")
    while moving or 0 < rounds < p.rounds:
        sent = edges.join(now.select("kind", F.col("host").alias("src"), "score"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * p.damping).alias("score"), none)
        held = own.select("*", none).unionByName(sent).unionByName(now.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before")))
        after = materialize(held.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.max("before").alias("before")), "urls-round")
        moving = not after.filter(F.col("before").isNull() | (F.col("score") - F.col("before") > p.tolerance * F.col("score"))).isEmpty()
        rounds += 1
        if now is not own:
            discard(now)
        now = after.select("kind", "host", "score")
    return now


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, p: Propagation = Propagation()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html).

    A null url or one without `://` has an empty host and path, no rule and no evidence, and is allowed, as is every host that
    no evidence reaches or whose trust and distrust tie, up to ten times p.tolerance. Null html has no links. Repeated rows count
    as often as they occur. trust and distrust are rounded to 12 decimals; verdicts come from the scores as they are.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    links = materialize(host_edges(judged), "urls-links")
    narrow = materialize(judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled")), "urls-pages")

    # a host's seed mass is its count of ruled pages, among all hosts of the kind
    counted = narrow.filter(F.col("ruled").isNotNull()).groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    counted = materialize(counted, "urls-seeds")
    totals = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    seeds = counted.select("kind", "host", (F.col("n") / F.when(F.col("kind") == "trust", float(totals.get("trust", 1))).otherwise(float(totals.get("distrust", 1)))).alias("mass"))

    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    out = materialize(both.groupBy("kind", "src").agg(F.sum("links").alias("all_links")), "urls-degrees")
    edges = materialize(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("all_links")).alias("share")), "urls-edges")
    scores = propagate(edges, seeds, p)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")))
    by_host = scores.groupBy(F.col("host").alias("_host")).agg(of("trust").alias("_trust"), of("distrust").alias("_distrust"))
    # distrust without any trust outweighs it, even where it is too small for a double
    over = F.col("_distrust").isNotNull() & (F.col("_trust").isNull() | (F.col("_distrust") > p.threshold * F.col("_trust") * (1 + 10 * p.tolerance)))
    rounded = lambda c: F.round(F.coalesce(F.col(f"_{c}"), F.lit(0.0)), 12).alias(c)
    by_host = materialize(by_host.select("_host", over.alias("over"), rounded("trust"), rounded("distrust")), "urls-hosts")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    joined = narrow.join(by_host, F.col("host") == F.col("_host"), "left").select("page_id", "host", "path", "rule", "ruled", "over", zero("trust"), zero("distrust"))
    verdict = F.coalesce("ruled", F.when(F.col("over"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
