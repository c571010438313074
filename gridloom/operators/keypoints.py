"""Keypoint tables: ranking, filters and projections between images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar


def top_n(df: DataFrame, n: int | None, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Ranks (from 1) keypoints by response, strongest first, then x and y; keeps n of each group, or all. Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("response"), "x", "y")
    out = df.withColumn("rank", F.row_number().over(w))
    return out if n is None else out.filter(F.col("rank") <= n)


def inside(df: DataFrame, nx: Column | int, ny: Column | int) -> DataFrame:
    """Points inside an image; the upper bounds are inclusive."""
    nx, ny = (c if isinstance(c, Column) else F.lit(c) for c in (nx, ny))
    return df.filter(~((F.col("x") < 0) | (F.col("x") > nx) | (F.col("y") < 0) | (F.col("y") > ny)))


def off_border(df: DataFrame, nx: int, ny: int, margin: int) -> DataFrame:
    """Points at least ``margin`` from the low borders and no further than that short of the size at the high ones."""
    x, y = F.col("x"), F.col("y")
    return df.filter(~((x < margin) | (x > nx - margin) | (y < margin) | (y > ny - margin)))


def reproject(df: DataFrame, h: Sequence[float], nx: float, ny: float, keep: int = 5000, by: Sequence[str] = ("image_id",), pad_to: int | None = None) -> DataFrame:
    """Keypoints through a homography: those inside the other image, the ``keep`` strongest, ranked from 0; px, py are the projections.

    ``pad_to`` fills every group up with points at the origin."""
    px, py = scalar.project(h, F.col("x"), F.col("y"))
    moved = df.withColumn("px", px).withColumn("py", py)
    ok = ~((F.col("px") < 0) | (F.col("px") > nx) | (F.col("py") < 0) | (F.col("py") > ny))
    w = Window.partitionBy(*by).orderBy(F.desc("response"), "x", "y")
    out = moved.filter(ok).withColumn("i", F.row_number().over(w) - 1).filter(F.col("i") < keep)
    if pad_to is None:
        return out
    sizes = df.select(*by).distinct().join(out.groupBy(*by).agg(F.count("*").cast("int").alias("n")), list(by), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pad = sizes.filter(F.col("n") < pad_to).select(*by, F.explode(F.sequence(F.col("n"), F.lit(pad_to - 1))).alias("i"))
    return out.unionByName(pad.withColumns({c: F.lit(0.0) for c in ("x", "y", "px", "py")}), allowMissingColumns=True)


def size_from_endpoints(points: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Adds the mean branch distance of the endpoints at each keypoint as its size (null without any)."""
    mean = endpoints.groupBy("image_id", "x", "y").agg(F.avg("distance").alias("size"))
    return points.join(mean, ["image_id", "x", "y"], "left")


def status(points: DataFrame, repeated: DataFrame, nx: float, ny: float, by: Sequence[str]) -> DataFrame:
    """0 not repeated, 1 outside, 2 repeated, per point (``by`` + i)."""
    keys = [*by, "i"]
    out = (F.col("x") < 0) | (F.col("x") > nx) | (F.col("y") < 0) | (F.col("y") > ny)
    j = points.join(repeated.select(*keys, F.lit(True).alias("r")), keys, "left")
    return j.withColumn("status", F.when(out, 1).when(F.col("r"), 2).otherwise(0)).drop("r")
