"""Connected components by alternating large-star and small-star.

Large-star hooks every larger neighbour of a node to the smallest node it
sees, small-star every smaller neighbour; both keep connectivity, and together
they end in one star around the smallest id of each component. Minima are
aggregated before they are shuffled, and a node with very many neighbours is
split by the skew join, so no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veldra.llm.store import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest id reachable) of every node of ``edges`` (columns a and b) that is not itself the smallest.

    Loops and repeated edges do no harm; edges with a null end are left out;
    no edges give no rows.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = staged(stars, "edges")
    before = _state(stars)
    while before[0]:
        stars = staged(_small_star(_large_star(stars)), "stars", instead_of=stars)
        now = _state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, component as ``components`` gives them, or None) with further ``links`` (a, b) taken in; only the links are worked on again."""
    if labels is None:
        return components(links)
    named = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of"))
    edges = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    found = components(edges.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    over = found.select(F.col("node").alias("component"), F.col("component").alias("least"))
    known = labels.join(over, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return staged(known.unionByName(found), "labels")
