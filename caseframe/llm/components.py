"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.shared import keep


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them; here u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())


def components(links: DataFrame) -> DataFrame:
    """Node and label (least node of its component) of all nodes of links (u, v), without loops.

    Ends when every edge points at a least node; a node of any degree costs one minimum and one
    join, which adaptive execution splits. Edges are kept after each round. Direction, repeated
    links and loops do not matter; nulls link nothing.
    """
    edges = keep(links.filter("u != v").select(F.greatest("u", "v").alias("u"),
                                               F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = keep(_small_star(_large_star(edges)), "links")
        state, before = _state(edges), state
        if state == before:
            break
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v"), F.col("v"))).groupBy("node").agg(
        F.min("label").alias("label"))
