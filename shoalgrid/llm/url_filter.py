"""URL filters: rules by host and path, and trust and distrust spread over the graph of hosts."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.store import single_value, written

#: (rule, verdict): a host, its subdomains with it, and the start of a path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]*)"""


def _host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), string.ascii_uppercase, string.ascii_lowercase)


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], of: int) -> Column:
    """The longest rule that fits (of=0) or its verdict (of=1); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule[0].partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule[of])).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): of the links on ``host``'s pages to other hosts, the share that goes to each. Relative links stay inside."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)).alias("href"))
    whole = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    links = links.filter(F.lower("href").rlike(r"^(https?:)?//")).select(F.col("host").alias("src"), _host(whole).alias("dst"))
    counts = links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").count()
    totals = counts.groupBy(F.col("src").alias("s")).agg(F.sum("count").alias("total"))
    return counts.join(totals, counts.src == totals.s).select("src", "dst", (F.col("count") / F.col("total")).alias("share"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, settled: float = 1e-4, every: int = 8, rounds: int = 400) -> DataFrame:
    """Personalised PageRank (host, rank) of (host, seed) over (src, dst, share).

    Ranks are scaled so that a host has its own seed and ``damping`` times what flows in. A round is one join and
    one pre-aggregated sum by host; every few rounds a table in the shared folder cuts the lineage. Ranks only grow,
    so their sum shows how far they are from the end: rounds go on until that is the share ``settled`` of it.
    """
    seeds = seeds.filter("host <> '' AND seed > 0")
    ranks, before = seeds.select("host", F.col("seed").alias("rank")), None
    for i in range(rounds):
        flow = edges.join(ranks, edges.src == ranks.host).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("share") * F.col("rank")).alias("rank"))
        ranks = flow.union(seeds.select("host", F.col("seed").alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % every == every - 1:
            ranks = written(ranks, "ranks")
            total = single_value(ranks, F.coalesce(F.sum("rank"), F.lit(0.0)))[0]
            # What is still to come is at most this growth times damping ** every / (1 - damping ** every).
            if before is not None and (total - before) * damping**every / (1 - damping**every) <= settled * total:
                return ranks
            before = total
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict, trust and distrust of every page's url.

    Where no rule fits, the graph of hosts decides. A host's seed of trust is the share of its pages that rules
    allow, of distrust the share that they block. Trust follows links by personalised PageRank. Distrust goes against
    them: it is the chance that a walk from the host along its links, going on with ``damping``, meets a blocked page,
    so it is 1 at most and doesn't depend on how many others link there. A host is blocked if its distrust is
    ``threshold`` or more and above its trust.

    A null url or one without :// has empty host and path, fits no rule and is allowed; a null page has no links;
    hosts without seeds or links are allowed; equal rows each come back; null ids and other columns make no difference.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", _host(F.col("url"))).withColumn("path", _path(F.col("url")))
    host, path = F.col("host"), F.col("path")
    ruled = written(rows.select("page_id", "host", "path", _rule(host, path, rules, 0).alias("rule"), _rule(host, path, rules, 1).alias("ruling")), "urls")
    edges = written(host_edges(rows.select("host", "html")), "edges")
    share = ruled.groupBy("host").agg(
        F.avg(F.when(F.col("ruling") == "allow", 1.0).otherwise(0.0)).alias("trusted"),
        F.avg(F.when(F.col("ruling") == "block", 1.0).otherwise(0.0)).alias("blocked"),
    )
    share = written(share, "seeds")
    trust = spread(share.select("host", F.col("trusted").alias("seed")), edges, damping)
    rest = share.select(F.col("host").alias("s"), (1 - F.col("blocked")).alias("rest")).filter("rest > 0")
    against = edges.join(rest, edges.src == rest.s).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") * F.col("rest")).alias("share"))
    distrust = spread(share.select("host", F.col("blocked").alias("seed")), written(against, "edges"), damping)
    both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust"))
    both = both.union(distrust.select("host", F.lit(0.0), F.col("rank"))).groupBy(F.col("host").alias("h"))
    both = both.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    out = ruled.join(both, ruled.host == both.h, "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("ruling", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
