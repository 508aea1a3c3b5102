"""URL filter: host and path rules, and for the rest personalised PageRank of trust against reversed distrust.

Edges run from the host of a page to the hosts that its links name, weighted by their number. Trust flows along them from the hosts of
pages that rules allow, distrust against them from those of pages that rules block. Both walks are iterated in one table until
they settle; what reaches a host without edges goes back to the seeds. A page without a rule is blocked where its host's distrust
exceeds ``ratio`` times its trust.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.plans.lineage import cut
from quarrylog.plans.scratch import Scratch

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LINK = r"(?i)href\s*=\s*[\"']?((?:\w+:)?//[^\"'\s>]+)"


def _split(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host (A-Z lower-cased) and path of a url; both empty without "://" or for null."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    df = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("__rest", r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(__rest, length(__raw) + 1)"), r"(?s)^[^?#]*", 0)
    df = df.withColumn("__raw", host).withColumn("path", path)
    return df.withColumn("host", F.translate("__raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).drop("__rest", "__raw")


def _rules(df: DataFrame) -> DataFrame:
    """The longest rule that fits host and path: ``rule`` and ``said`` (null: none)."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, said = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return df.withColumn("rule", rule).withColumn("said", said)


def link_edges(df: DataFrame) -> DataFrame:
    """``(a, b, w)``: how many links (absolute ones, or without a scheme) lead from pages (host, html) of host a to host b."""
    links = df.select(F.col("host").alias("a"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("__to"))
    links = _split(links.withColumn("__to", F.regexp_replace("__to", "^//", "x://")), "__to")
    return links.where("a <> host and a <> '' and host <> ''").groupBy("a", F.col("host").alias("b")).agg(F.count("*").alias("w"))


def page_ranks(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, max_rounds: int = 200) -> DataFrame:
    """``(kind, host, rank)``: personalised PageRank over ``edges`` (kind, a, b, w) from ``seeds`` (kind, host, seed), for each kind apart.

    Seeds are scaled to sum to 1 for each kind; hosts without seeds or edges are not in the result. Rounds end when the ranks of a kind change by
    less than ``tolerance`` in sum (an error if that takes more than ``max_rounds``); one row for each kind reaches the driver.
    """
    steps = Scratch(edges.sparkSession)
    total = edges.groupBy("kind", "a").agg(F.sum("w").alias("total"))
    shares = steps.put(edges.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("w") / F.col("total")).alias("share")))
    names = shares.select("kind", F.col("a").alias("host"), F.lit(0.0).alias("seed"), F.lit(1).alias("out"))
    names = names.union(shares.select("kind", "b", F.lit(0.0), F.lit(0))).union(seeds.select("kind", "host", F.col("seed").cast("double"), F.lit(0)))
    nodes = steps.put(names.groupBy("kind", "host").agg(F.sum("seed").alias("seed"), F.max("out").alias("out")))
    sums = {r["kind"]: r["s"] for r in nodes.groupBy("kind").agg(F.sum("seed").alias("s")).collect()}
    scale = F.lit(0.0)
    for kind, s in sums.items():
        scale = F.when(F.col("kind") == kind, 1.0 / s if s else 0.0).otherwise(scale)
    ranks = steps.put(nodes.withColumn("seed", F.col("seed") * scale).withColumn("rank", F.col("seed")))
    ends = {r["kind"]: r["lost"] for r in ranks.groupBy("kind").agg(F.sum(F.when(F.col("out") == 0, F.col("rank")).otherwise(0.0)).alias("lost")).collect()}
    for _ in range(max_rounds):
        lost = F.lit(0.0)
        for kind, mass in ends.items():
            lost = F.when(F.col("kind") == kind, mass).otherwise(lost)
        moved = ranks.join(shares.withColumnRenamed("a", "host"), ["kind", "host"]).groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + lost * F.col("seed"))
        after = steps.put(ranks.drop("was").withColumnRenamed("rank", "was").join(moved, ["kind", "host"], "left").select("kind", "host", "seed", "out", rank.alias("rank"), "was"))
        seen = after.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change"), F.sum(F.when(F.col("out") == 0, F.col("rank")).otherwise(0.0)).alias("lost")).collect()
        steps.drop(ranks)
        ranks, ends = after, {r["kind"]: r["lost"] for r in seen}
        if max([0.0, *(r["change"] for r in seen)]) < tolerance:
            break
    else:
        raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")
    out = cut(ranks.select("kind", "host", "rank"))
    steps.drop()
    return out


def judge_pages(pages: DataFrame, damping: float = 0.85, ratio: float = 1.0, tolerance: float = 1e-4, parents: bool = False) -> DataFrame:
    """``pages`` without html, with host, path, rule, trust, distrust and verdict (block or allow).

    A null url or html has no host or links. Hosts that no seed reaches have ranks of 0 and are allowed. A page counts for
    its host as often as it is in the table. ``parents`` adds edges between a host and its parent domain, both ways, for tables that hold no
    links between hosts; single labels and parents of two letters and at most three (as co.uk) have none. Columns of
    ``pages`` with the names of the results are replaced. An empty table gives an empty one.
    """
    df = _split(pages.drop("host", "path", "rule", "verdict", "trust", "distrust", "said"), "url")
    light = cut(_rules(df.drop("html")))
    edges = link_edges(df)
    if parents:
        up = F.expr("substring(host, instr(host, '.') + 1)")
        hosts = light.select("host").distinct().select(F.col("host").alias("a"), up.alias("b")).where(r"instr(b, '.') > 0 and not b rlike '^[^.]{1,3}\\.[a-z]{2}$'")
        edges = edges.union(hosts.withColumn("w", F.lit(1))).union(hosts.select("b", "a", F.lit(1))).groupBy("a", "b").agg(F.sum("w").alias("w"))
    edges = cut(edges)
    both = edges.select(F.lit("trust").alias("kind"), "a", "b", "w").union(edges.select(F.lit("distrust"), "b", "a", "w"))
    share = lambda x: F.avg(F.when(F.col("said") == x, 1.0).otherwise(0.0))
    seeds = light.where("host <> ''").groupBy("host").agg(share("allow").alias("t"), share("block").alias("d"))
    seeds = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "t", F.lit("distrust"), "d")).alias("kind", "seed")).where("seed > 0")
    ranks = page_ranks(both, seeds, damping, tolerance)
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    judged = cut(ranks.groupBy(F.col("host").alias("__host")).agg(of("trust"), of("distrust")))
    out = light.join(judged, F.col("host") == F.col("__host"), "left").drop("__host")
    out = out.withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    verdict = F.coalesce("said", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("said")
