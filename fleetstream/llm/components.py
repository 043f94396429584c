"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def merged(old: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b): only the
    components that they connect are worked on."""
    for c in ("a", "b"):
        place = old.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        links = links.join(place, c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    links = stored(links, "component-links")
    new = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(
        F.col("node").alias("component"), F.col("component").alias("to"))
    # nodes that had no link before are components by themselves
    alone = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct().join(
        old, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return (old.unionByName(alone).join(new, "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): component is the smallest node of
    each component.  Nodes without an edge don't occur.

    A large star links every larger neighbour of a node to its smallest
    neighbour; a small star links the smaller ones.  Both keep the components,
    and alternating them ends in stars after about log(n) rounds.  The minima
    are combined before the shuffle, so a node with many neighbours is no hot
    spot but in the join, whose large side Spark can split.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                 "components")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .filter("u <> v").distinct(), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = stored(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        # stars: no node is both an end and a centre, and each end has one centre
        roles = small.select(F.col("u").alias("x"), F.lit(1).alias("end"), F.lit(0).alias("centre")).unionByName(
            small.select(F.col("v").alias("x"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
        roles = roles.groupBy("x").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre"))
        now = small
        if roles.filter("ends + centre > 1").isEmpty():
            break
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
