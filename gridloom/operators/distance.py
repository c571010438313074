"""Nearest sites, distance transforms and skeletons of layers (image_id, level, x, y, fg)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import wrap_distance

KEY = ["image_id", "level", "x", "y"]
LAYER = ["image_id", "level"]


def _lead(c: str, d: int, along: str) -> Column:
    w = Window.partitionBy(*LAYER, "y" if along == "x" else "x").orderBy(along)
    return F.lead(c, d).over(w) if d > 0 else F.lag(c, -d).over(w)


def boundary(layers: DataFrame) -> DataFrame:
    """Adds edge: foreground pixels with a background 4-neighbour; outside the image counts as background."""
    out = lambda d, along: ~F.coalesce(_lead("fg", d, along), F.lit(False))
    return layers.withColumn("edge", F.col("fg") & (out(1, "x") | out(-1, "x") | out(1, "y") | out(-1, "y")))


def flags(df: DataFrame, threshold: float) -> DataFrame:
    """0 alive, 1 narrow band, 2 far away: above a positive threshold (below the magnitude of a negative one) is far away, its pixels next to alive ones the band."""
    inside = F.col("v") >= threshold if threshold >= 0 else F.col("v") <= -threshold
    b = boundary(df.select("image_id", F.lit(0).alias("level"), "x", "y", inside.alias("fg")))
    return b.select("image_id", "x", "y", F.when(~F.col("fg"), 0).when(F.col("edge"), 1).otherwise(2).alias("flag"))


def nearest_site(df: DataFrame, site: str = "edge") -> DataFrame:
    """Adds d2, sx, sy: squared distance to and place of the nearest site (ties: smaller sy, then sx); null in layers without sites.

    Exact and separable: each column finds its nearest site above and below by window functions, then a pixel takes the
    best of its row's columns. Work is the number of pixels times the row's width, dealt by (image, level, row)."""
    up = Window.partitionBy(*LAYER, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*LAYER, "x").orderBy("y").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(site), F.col("y"))
    cols = df.withColumn("a", F.last(at, ignorenulls=True).over(up)).withColumn("b", F.first(at, ignorenulls=True).over(down))
    near = F.when(F.col("b").isNull() | (F.col("y") - F.col("a") <= F.col("b") - F.col("y")), F.col("a")).otherwise(F.col("b"))
    cols = cols.withColumn("cy", near)
    rows = cols.filter("cy IS NOT NULL").groupBy(*LAYER, "y").agg(F.collect_list(F.struct("x", "cy")).alias("sites"))  # a row's columns
    d2 = lambda s: (F.col("x") - s["x"]) * (F.col("x") - s["x"]) + (F.col("y") - s["cy"]) * (F.col("y") - s["cy"])
    best = F.array_min(F.transform("sites", lambda s: F.struct(d2(s).alias("d2"), s["cy"].alias("sy"), s["x"].alias("sx"))))
    out = df.join(rows, [*LAYER, "y"], "left").withColumn("s", best)
    return out.select(*df.columns, "s.d2", "s.sx", "s.sy")


def distances(sites: DataFrame) -> DataFrame:
    """Adds dt (Euclidean) and dt_floor (whole)."""
    dt = F.sqrt(F.col("d2").cast("double"))
    return sites.withColumn("dt", dt).withColumn("dt_floor", F.floor(dt).cast("int"))


def within(sites: DataFrame, t: float) -> DataFrame:
    return sites.filter(F.col("d2") <= t * t)


def importance(sites: DataFrame, length: str = "length") -> DataFrame:
    """From rows with d2, label (arc length of the own nearest site) and the boundary's length: adds importance (largest label
    difference to the 4 neighbours, the shorter way round) and saliency (importance over distance); null at sites and on the outermost pixels."""
    diff = lambda c: F.abs(F.col("label") - c)
    steps = [diff(_lead("label", d, along)) for along in ("x", "y") for d in (1, -1)]
    top = F.greatest(*steps)
    inner = F.lit(True)
    for s in steps:
        inner = inner & s.isNotNull()
    i = F.when(inner & (F.col("d2") > 0), wrap_distance(top, F.col(length)))
    return sites.withColumn("importance", i).withColumn("saliency", F.col("importance") / F.sqrt(F.col("d2").cast("double")))


def skeleton(field: DataFrame, saliency: float) -> DataFrame:
    """Pixels of enough saliency whose importance exceeds 1, thin weak ones left out."""
    keep = (F.col("saliency") >= saliency) & (F.col("importance") > 1) & ~((F.col("importance") < 5) & (F.sqrt(F.col("d2").cast("double")) < 1.5))
    return field.filter(keep)


def combine_skeletons(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pixels of both skeletons with the smaller importance."""
    return one.join(two.select(*KEY, F.col("importance").alias("other")), KEY).withColumn("importance", F.least("importance", "other")).drop("other")


def skeleton_interpolation(sites: DataFrame, skeletons: DataFrame) -> DataFrame:
    """Adds to rows with d2 the distance to the skeleton and b = least(dt / (dt + skeleton distance), 1), 0 at sites."""
    marked = sites.select(*KEY, F.col("d2").alias("bd2")).join(skeletons.select(*KEY, F.lit(True).alias("skel")), KEY, "left")
    near = nearest_site(marked.withColumn("skel", F.coalesce("skel", F.lit(False))), "skel")
    dt, sd = F.sqrt(F.col("bd2").cast("double")), F.sqrt(F.col("d2").cast("double"))
    return near.select(*KEY, dt.alias("dt"), sd.alias("skeleton_dt"), F.when(dt > 0, F.least(F.lit(1.0), dt / (dt + sd))).otherwise(0.0).alias("b"))


def exact_distance(layers: DataFrame) -> DataFrame:
    """Distance to the nearest edge pixel plus 1 by comparing each pixel with all edge pixels of its layer; a check for small layers."""
    b = boundary(layers)
    edges = b.filter("edge").select(*LAYER, F.col("x").alias("ex"), F.col("y").alias("ey"))
    d2 = (F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey"))
    return b.join(edges, LAYER).groupBy(*KEY).agg((F.sqrt(F.min(d2).cast("double")) + 1).alias("dt"))
