"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import durable


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node of its neighbourhood (edges run from larger to smaller); rows may repeat."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("u").alias("to")))
    least = edges.select(F.inline(ends)).groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("m"))
    return edges.join(least.withColumnRenamed("node", "v").hint("merge"), "v").select("u", F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them (edges run from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least.hint("merge"), "u")
    return (
        joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    )


def tangled(edges: DataFrame) -> bool:
    """Whether any node has several edges to smaller nodes, or one and is itself such a smaller node."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    return nodes.filter("out > 1 OR (out > 0 AND n > out)").count() > 0


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge, but for the components' smallest nodes, which are what the components are called.

    Groups are reduced to minima before the shuffle and joined back by sort-merge joins (by hint, so that no small table
    is built in the driver for a broadcast), so a node with very many edges is split by adaptive execution. Each round is checkpointed in the shared folder; edges that
    are stars already need none."""
    u, v = F.greatest(a, b), F.least(a, b)
    out = durable(edges.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")))
    while tangled(out):
        out = durable(small_star(large_star(out)))
    return out.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component is its smallest node."""
    nodes = stars(edges, a, b)
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
