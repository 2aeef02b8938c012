"""Connected components by contraction; nothing of the graph reaches the driver.

Each node points at its smallest neighbour, pointers are shortened to their ends, and only the edges between different ends are left for the
next round. A node that stays absorbs another one within two rounds, so each edge is met a few times, however wide a component is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns node, component (its smallest node) for each node of an edge."""
    spark = edges.sparkSession
    rounds: list[DataFrame] = []
    pairs = keep(spark, edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        # of an edge, the larger node points at the smaller one; the smallest of a neighbourhood at itself
        up = pairs.select(F.col("b").alias("u"), F.col("a").alias("c")).union(pairs.select(F.col("a").alias("u"), F.col("a").alias("c")))
        up = keep(spark, up.groupBy("u").agg(F.min("c").alias("c")), "labels")
        while True:
            step = up.select(F.col("u").alias("c"), F.col("c").alias("far"))
            twice = up.join(step, "c").select("u", F.col("far").alias("c")).join(step, "c").select("u", F.col("far").alias("c"), (F.col("far") < F.col("c")).alias("moved"))
            ends = keep(spark, twice, "labels")
            discard(spark, up)
            up = ends.select("u", "c")
            up._kept_path = ends._kept_path
            if not ends.filter("moved").limit(1).count():
                break
        rounds.append(up)
        left = pairs.join(up.select(F.col("u").alias("a"), F.col("c").alias("x")), "a").join(up.select(F.col("u").alias("b"), F.col("c").alias("y")), "b").filter("x <> y")
        left = keep(spark, left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(spark, pairs)
        pairs = left
        if not pairs.limit(1).count():
            break
    discard(spark, pairs)
    found = rounds[0]
    if len(rounds) == 1:
        return found.select(F.col("u").alias("node"), F.col("c").alias("component"))
    for up in rounds[1:]:
        found = found.join(up.select(F.col("u").alias("c"), F.col("c").alias("end")), "c", "left").select("u", F.coalesce("end", "c").alias("c"))
    found = keep(spark, found.select(F.col("u").alias("node"), F.col("c").alias("component")), "components")
    discard(spark, *rounds)
    return found


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) with more links (a, b): only what the links join is walked, each component standing for its nodes."""
    spark = found.sparkSession
    named = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    lifted = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    moved = components(lifted)
    old = found.join(moved.select(F.col("node").alias("component"), F.col("component").alias("end")), "component", "left").select("node", F.coalesce("end", "component").alias("component"))
    return keep(spark, old.union(moved.join(found.select("node"), "node", "left_anti").select("node", "component")), "components")
