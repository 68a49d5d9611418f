"""URL filters by propagation over the link graph of hosts.

Rules judge the urls they fit.  Their verdicts seed the hosts: a host's trust seed is its share of
all allowed pages, its distrust seed its share of all blocked ones.  Trust flows along links
(personalised PageRank), distrust against them, both by power iteration over distinct host edges until scores settle;
the flow of a host with no link onward ends there.  A host is blocked when its distrust exceeds
its trust by more than ``margin``.  Pages that no rule fits take their host's verdict.

Hosts that hold a large share of the pages (at most ``heavy_k``) are broadcast; others meet their
pages in one shuffle.

Defined results: null and repeated ids are pages like others; null urls and urls without ``://`` have empty host and path and take the verdict
of the empty host; null html has no links; repeated rows count as separate pages; a host with
neither trust nor distrust is allowed; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, written

LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts; ``pages(host, html)``."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    # links that name no scheme get one
    full = links.select("host", F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")).alias("link"))
    pairs = full.select(F.col("host").alias("src"), host_of(F.col("link")).alias("dst"))
    return pairs.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, max_rounds: int = 1000) -> DataFrame:
    """``(kind, host, score)`` from ``edges(kind, src, dst, p)`` and ``seeds(kind, host, seed)``.

    Ends when a round changes the scores (of 1 in all) by less than ``tolerance`` together; raises after ``max_rounds``.
    """
    seeds = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    if edges.isEmpty():
        return seeds
    # every round reads a table, so that the join may split a host with very many links
    scores = written(seeds.withColumn("change", F.col("score")), "scores")
    for _ in range(max_rounds):
        now = scores.select("kind", "host", "score")
        flow = now.withColumnRenamed("host", "src").join(edges.hint("merge"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"), F.lit(0.0).alias("old"))
        rows = flow.union(seeds.withColumn("old", F.lit(0.0))).union(now.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("old")))
        moved = written(rows.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.abs(F.sum("score") - F.sum("old")).alias("change")), "scores")
        discard(scores)
        scores = moved
        if (scores.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            return scores.drop("change")
    raise RuntimeError(f"scores not settled after {max_rounds} rounds")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = 0.85, tolerance: float = 1e-4, margin: float = 0.0, heavy_k: int = 512) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, host_trust, host_distrust``."""
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", name).withColumn("by_rule", verdict)
    hosts = written(seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked")), "hosts")
    total, allowed, blocked = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("allowed"), F.sum("blocked")).first())
    kinds = [(k, c, t) for k, c, t in (("trust", "allowed", allowed), ("distrust", "blocked", blocked)) if t]
    links = written(host_edges(pages.select(host_of(url).alias("host"), F.col(html_col).alias("html"))), "links")
    out_n, in_n = (links.groupBy(c).agg(F.sum("n").alias("all")) for c in ("src", "dst"))
    forth = links.join(out_n, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("p"))
    back = links.join(in_n, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("p"))
    edges = written(forth.union(back), "edges")
    named = hosts.select("host", "n")
    for kind, count, sum_ in kinds:
        seeds = hosts.where(F.col(count) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(count) / F.lit(float(sum_))).alias("seed"))
        got = propagate(edges.where(F.col("kind") == kind), seeds, damping, tolerance)
        named = named.join(got.select("host", F.col("score").alias(kind)), "host", "left")
    for kind in ("trust", "distrust"):
        named = named.withColumn(f"host_{kind}", F.round(F.coalesce(F.col(kind), F.lit(0.0)), 12) if kind in named.columns else F.lit(0.0))
    blocks = F.col("host_distrust") - F.col("host_trust") > margin
    named = written(named.select("host", "n", "host_trust", "host_distrust", F.when(blocks, "block").otherwise("allow").alias("by_host")), "verdicts")
    heavy = F.col("n") * heavy_k >= total  # at most heavy_k hosts
    first = seen.join(F.broadcast(named.where(heavy).drop("n")), "host", "left")
    second = first.where(F.col("by_host").isNull()).drop("by_host", "host_trust", "host_distrust").join(named.where(~heavy).drop("n"), "host")
    both = first.where(F.col("by_host").isNotNull()).unionByName(second)
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host").alias("verdict"), "host_trust", "host_distrust")
