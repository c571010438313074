"""Trees as edge tables: sums over subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import durable


def subtree_sums(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """From (node, parent, value): each node's number of descendants and the sum of values of its subtree, itself included.

    Ancestors are found by doubling: each round joins a table of links with itself, so a tree of depth d takes log2(d) rounds."""
    links = durable(nodes.filter("parent IS NOT NULL").select("node", F.col("parent").alias("above"), F.lit(1).alias("steps")))
    reach, covered = links, 1
    while covered < depth:
        far = reach.filter(F.col("steps") == covered).select(F.col("node").alias("above"), F.col("above").alias("top"))
        more = durable(reach.join(far, "above").select("node", F.col("top").alias("above"), (F.col("steps") + covered).alias("steps")))
        if more.isEmpty():
            break
        reach = durable(reach.unionByName(more))
        covered *= 2
    own = nodes.select("node", "value")
    below = reach.join(own, "node").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    out = own.join(below, "node", "left")
    return out.select("node", F.coalesce("n", F.lit(0)).alias("descendants"), (F.col("value") + F.coalesce("s", F.lit(0))).alias("total"))
