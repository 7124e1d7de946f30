"""URL filter: rules first, then link-graph propagation over hosts.

Method
* A url's host and path are cut by the first ``://``. The longest rule that fits its host (or a parent domain) and path decides.
* Other urls are judged by their host: personalised PageRank spreads trust from hosts with allowed pages along host
  edges, and distrust from hosts with blocked pages against them (who links to a blocked host is distrusted).
  Seeds weigh as many as their pages that a rule decided. A host is blocked if its distrust is greater than ``ratio``
  times its trust; a host that neither reaches is allowed.
* A host edge leads from a page's host to each host that the page links to or names, if that host has pages, and
  from a host to its parent domains that have pages. Its weight is the number of such pages. Ranks are
  ``ROUNDS`` power steps with ``DAMPING``; a host without an edge keeps what it gets.

Only host pairs and ranks are shuffled, pre-aggregated; the edges of a frequent host are pairs of hosts, not pages.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed; null html has
no links; repeated rows are judged alike and count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracekit.llm.common import settle, ship

ship(__name__)

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_RULES = 1000  # they become one expression
ROUNDS = 20
DAMPING = 0.85
DIGITS = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOTTED = r"([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"
NAMED_BACKWARDS = r"(?<![A-Za-z])[A-Za-z]{2,}+\.[A-Za-z0-9.-]++$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rule(rules: Sequence[tuple[str, str, str]], result: int | None) -> Column:
    """The verdict (result 0) or the text (None) of the longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.lit(verdict if result == 0 else host + path)).otherwise(out)
    return out


def named_hosts(html: str) -> Column:
    """Lower-cased hosts that a text names: dotted labels up to the last one that starts with two letters, and these letters.

    A full stop after a host is not part of it. Read from the end, so that no pattern goes back.
    """
    runs = F.regexp_extract_all(html, F.lit(DOTTED))
    names = F.transform(runs, lambda x: F.translate(F.reverse(F.regexp_extract(F.reverse(x), NAMED_BACKWARDS, 0)), UPPER, LOWER))
    return F.filter(F.array_distinct(names), lambda x: x != "")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts that have pages, from (host, html)."""
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    named = named_hosts("html")
    links = (pages.where("host <> '' and html is not null").select("host", F.explode(named).alias("dst"))
             .groupBy("host", "dst").agg(F.count("*").alias("n")))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.where(F.size(labels) > 1).select("host", F.explode(parents).alias("dst"), F.col("pages").alias("n"))
    known = hosts.select(F.col("host").alias("dst"))
    return (links.unionByName(up).join(known, "dst", "left_semi").where("host <> dst")
            .groupBy(F.col("host").alias("src"), "dst").agg(F.sum("n").alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank) from (kind, src, dst, n) and (kind, host, seed), seeds adding up to 1 in each kind.

    A host without an edge of its kind keeps its mass.
    """
    total = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = settle(edges.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")))
    ranks = seeds.withColumnRenamed("seed", "rank")
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    for i in range(rounds):
        moved = (ranks.join(shares, ["kind", "host"], "left")
                 .select("kind", F.coalesce("dst", "host").alias("host"), (F.col("rank") * F.coalesce("share", F.lit(1.0)) * damping).alias("rank")))
        ranks = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3:
            ranks = settle(ranks)
    return ranks


def judge_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = rows.withColumns({"rule": _rule(rules, None), "decided": _rule(rules, 0)})
    edges = settle(host_edges(rows.select("host", "html")))
    both = edges.withColumn("kind", F.lit("allow")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("block").alias("kind")))
    seeds = ruled.where("decided is not null and host <> ''").groupBy(F.col("decided").alias("kind"), "host").agg(F.count("*").alias("n"))
    mass = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = settle(seeds.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed")))
    ranks = propagate(both, seeds)
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)), DIGITS)
    hosts = settle(ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("decided", F.when(distrust > F.lit(ratio) * trust, "block").otherwise("allow"))
    return ruled.drop("html").join(hosts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                                                   trust.alias("trust"), distrust.alias("distrust"))
