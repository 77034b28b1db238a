"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexloom.plans.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hang the neighbours of each node on the smallest of them (or on the node itself)."""
    if large:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, component)``; the component is the smallest node id it holds.

    Nodes without a link do not appear. A link of a node with itself has no effect.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())

    seen = mark(now)
    while seen[0]:
        after = scratch.save(_star(_star(now, True), False))
        scratch.drop(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
