"""Matching keypoints between two images, and the quality metrics made from the matches.

Tables are ranked from 0: a(by..., i, x, y[, descriptor]) and b(by..., j, x, y[, descriptor]); ``by`` names the
image pair. Matching by distance buckets the plane in cells of the radius and joins cells, so work follows
the number of close pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar


def close_pairs(a: DataFrame, b: DataFrame, radius: float, by: Sequence[str]) -> DataFrame:
    """(by..., i, j, d2) of all pairs at most ``radius`` apart."""
    cells = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("c")
    left = a.select(*by, "i", F.col("x").alias("ax"), F.col("y").alias("ay"), cells)
    left = left.withColumn("cx", F.floor(F.col("ax") / radius) + F.col("c.dx")).withColumn("cy", F.floor(F.col("ay") / radius) + F.col("c.dy")).drop("c")
    right = b.select(*by, "j", F.col("x").alias("bx"), F.col("y").alias("by_"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    d2 = scalar.squared_distance("ax", "ay", "bx", "by_")
    return left.join(right, [*by, "cx", "cy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select(*by, "i", "j", "d2")


def first_match(a: DataFrame, b: DataFrame, radius: float, by: Sequence[str]) -> DataFrame:
    """For each i the smallest j within the radius; the size of b's group without one."""
    first = close_pairs(a, b, radius, by).groupBy(*by, "i").agg(F.min("j").alias("j"))
    size = b.groupBy(*by).agg(F.count("*").cast("int").alias("nb"))
    out = a.select(*by, "i").join(first, [*by, "i"], "left").join(size, list(by), "left")
    return out.select(*by, "i", F.coalesce("j", "nb", F.lit(0)).alias("j"), F.col("j").isNotNull().alias("repeated"))


def repeated_pairs(a: DataFrame, b: DataFrame, radius: float, n: int, by: Sequence[str]) -> DataFrame:
    """First matches among the first points, both ranks at most n."""
    return first_match(a, b, radius, by).filter(F.col("repeated") & (F.col("i") <= n) & (F.col("j") <= n)).select(*by, "i", "j")


def early(flags: DataFrame) -> DataFrame:
    """First matches in which a point counts as repeated only if its match is among as many points of the other image as it is itself (j <= i), as precision asks."""
    return flags.withColumn("repeated", F.col("repeated") & (F.col("j") <= F.col("i")))


def running_precision(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds precision (share of repeated points up to i) and hits (their number)."""
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return flags.withColumn("hits", F.sum(F.col("repeated").cast("int")).over(w)).withColumn("precision", F.col("hits") / (F.col("i") + 1))


def average_precision(flags: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Mean precision at the first n repeated points; 0 with fewer than n."""
    p = running_precision(flags, by)
    top = F.when(F.col("repeated") & (F.col("hits") <= n), F.col("precision"))
    return p.groupBy(*by).agg(F.when(F.count_if("repeated") >= n, F.sum(top) / n).otherwise(0.0).alias("ap"))


def prefix_matches(a: DataFrame, b: DataFrame, radius: float, n: int, by: Sequence[str]) -> DataFrame:
    """Curves over prefixes of the ranked points: (by..., k, repeated, matched) for k = 1..n.

    Point i counts at k > i: repeated if any of b's first k points is within the radius, matched if the one of
    the nearest descriptor among them is (the later one on ties); both sums are divided by k. All n x n pairs of an
    image pair are compared (n is a parameter), spread over (pair, i)."""
    left = a.filter(F.col("i") < n).select(*by, "i", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("descriptor").alias("da"))
    right = b.filter(F.col("j") < n).select(*by, "j", F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("descriptor").alias("db"))
    pairs = left.join(right, list(by)).select(
        *by, "i", "j", (scalar.squared_distance("ax", "ay", "bx", "by_") <= radius * radius).alias("near"), scalar.descriptor_distance("da", "db").alias("fd")
    )
    w = Window.partitionBy(*by, "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    run = pairs.withColumn("correct", F.min_by("near", F.struct("fd", -F.col("j"))).over(w)).withColumn("any", F.max("near").over(w))
    k = F.col("j") + 1
    sums = run.filter(F.col("j") >= F.col("i")).groupBy(*by, k.alias("k")).agg(F.count_if("any").alias("r"), F.count_if("correct").alias("m"))
    return sums.select(*by, "k", (F.col("r") / F.col("k")).alias("repeated"), (F.col("m") / F.col("k")).alias("matched"))


def symmetric_matches(a: DataFrame, b: DataFrame, radius: float, n: int, by: Sequence[str]) -> DataFrame:
    """Mean of the curves of both directions."""
    flip = lambda t, old, new: t.withColumnRenamed(old, new)
    one, two = prefix_matches(a, b, radius, n, by), prefix_matches(flip(b, "j", "i"), flip(a, "i", "j"), radius, n, by)
    j = one.join(two.select(*by, "k", F.col("repeated").alias("r2"), F.col("matched").alias("m2")), [*by, "k"])
    return j.select(*by, "k", ((F.col("repeated") + F.col("r2")) * 0.5).alias("repeated"), ((F.col("matched") + F.col("m2")) * 0.5).alias("matched"))


def pair_distances(points: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Distances of all ordered pairs among the first n points (rank i) of each group."""
    p = points.filter(F.col("i") < n)
    q = p.select(*by, F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return p.join(q, list(by)).filter(F.col("i") != F.col("j")).select(*by, "i", "j", scalar.distance("x", "y", "x2", "y2").alias("d"))


def coverage(points: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Harmonic coverage of the first n points: n over the summed mean inverse distances; null with fewer than n or coinciding points."""
    each = pair_distances(points, n, by).groupBy(*by, "i").agg((F.sum(F.when(F.col("d") > 0, 1 / F.col("d"))) / (n - 1)).alias("inv"), F.min("d").alias("least"))
    whole = each.groupBy(*by).agg(F.count("*").alias("m"), F.sum("inv").alias("total"), F.min("least").alias("least"))
    found = whole.select(*by, F.when((F.col("m") >= n) & (F.col("least") > 0), n / F.col("total")).alias("coverage"))
    return points.select(*by).distinct().join(found, list(by), "left")


def least_distance(a: DataFrame, b: DataFrame, by: Sequence[str], cap: float = 10000.0) -> DataFrame:
    """Smallest distance between two point sets, equal points left out, ``cap`` at most."""
    q = b.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = scalar.distance("x", "y", "x2", "y2")
    return a.join(q, list(by)).groupBy(*by).agg(F.coalesce(F.least(F.lit(cap), F.min(F.when(d > 0, d))), F.lit(cap)).alias("d"))


def image_pairs(images: DataFrame) -> DataFrame:
    """(scene, pair_no): the first image of each scene with every other (image_no from 1)."""
    return images.filter("image_no > 1").select("scene", (F.col("image_no") - 1).alias("pair_no"))


def mean_curve(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of repeated and matched at each k over pairs; by scene, or over all."""
    return curves.groupBy(*by, "k").agg((F.sum("repeated") / F.count("*")).alias("repeated"), (F.sum("matched") / F.count("*")).alias("matched"))


def scene_summary(metrics: DataFrame) -> DataFrame:
    """MAP and coverage by scene, and the row 'Total': the mean of the scenes' values."""
    scenes = metrics.groupBy("scene").agg((F.sum("ap") / F.count("*")).alias("map"), (F.sum("coverage") / F.count("coverage")).alias("coverage"))
    total = scenes.agg((F.sum("map") / F.count("*")).alias("map"), (F.sum("coverage") / F.count("coverage")).alias("coverage"))
    return scenes.unionByName(total.select(F.lit("Total").alias("scene"), "map", "coverage"))


def overall(metrics: DataFrame) -> DataFrame:
    """Number of pairs, of failed ones (null ap) and the MAP that counts those as 0."""
    return metrics.agg(F.count("*").alias("pairs"), F.count_if(F.col("ap").isNull()).alias("failed"), (F.coalesce(F.sum("ap"), F.lit(0.0)) / F.count("*")).alias("map"))
