"""A detector's quality over a dataset: keypoints of all images, projected along homographies, matched and summed up.

Scenes hold images numbered from 1; image 1 is compared with each other one through the homography from 1 to it. Everything is
keyed by (scene, pair_no), so all pairs of all scenes are evaluated together. What several results need (rasters, keypoints,
projected points, curves) is checkpointed once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import match
from gridloom.operators.detectors import detect
from gridloom.session import durable
from gridloom.sources import readers

PAIR = ["scene", "pair_no"]


@dataclass
class Evaluation:
    """pairs: scene, pair_no, ap, coverage; summary: scene (and 'Total'), map, coverage; overall: pairs, failed, map;
    curves: scene, pair_no, k, repeated[, matched]; scene_curves and mean_curve: their means."""

    pairs: DataFrame
    summary: DataFrame
    overall: DataFrame
    curves: DataFrame
    scene_curves: DataFrame
    mean_curve: DataFrame


def projected(points: DataFrame, h: DataFrame, size: DataFrame, keep: int) -> DataFrame:
    """(scene, pair_no, x, y, response[, descriptor]) through each pair's h: adds px, py and rank i (from 0) of the ``keep`` strongest that fall into the other image (scene, pair_no, nx, ny)."""
    px, py = scalar.project(F.col("h"), F.col("x"), F.col("y"))
    moved = points.join(h, PAIR).join(size, PAIR).withColumn("px", px).withColumn("py", py)
    inside = ~((F.col("px") < 0) | (F.col("px") > F.col("nx")) | (F.col("py") < 0) | (F.col("py") > F.col("ny")))
    w = Window.partitionBy(*PAIR).orderBy(F.desc("response"), "x", "y")
    return moved.filter(inside).withColumn("i", F.row_number().over(w) - 1).filter(F.col("i") < keep).drop("h", "nx", "ny")


def inverse(h: DataFrame) -> DataFrame:
    """Inverse homographies by cofactors; those without one are left out."""
    a, b, c, d, e, f, g, i, j = (F.col("h")[k] for k in range(9))
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    adjoint = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return h.filter(det != 0).withColumn("h", F.array(*[v / det for v in adjoint]))


def evaluate(
    images: DataFrame,
    homographies: DataFrame,
    keypoints: DataFrame,
    radius: float = 3.0,
    curve_points: int = 1000,
    precision_points: int = 100,
    coverage_points: int = 200,
    keep: int = 5000,
) -> Evaluation:
    """The whole evaluation from images (scene, number, image_id, nx, ny), homographies (scene, number, h; number 0 serves all images
    of the scene) and keypoints (image_id, x, y, response and, if matching is to be judged, descriptor).

    A pair without its homography counts as failed (null precision); with too few points its precision is 0 and its coverage null."""
    described = "descriptor" in keypoints.columns
    points = durable(keypoints.select("image_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "response", *(["descriptor"] if described else [])))
    first = images.filter("number = 1").select("scene", F.col("image_id").alias("one"), F.col("nx").alias("nx1"), F.col("ny").alias("ny1"))
    pairs = images.filter("number > 1").join(first, "scene").withColumn("pair_no", F.col("number") - 1)
    own = homographies.filter("number > 1").select("scene", (F.col("number") - 1).alias("pair_no"), "h")
    common = homographies.filter("number = 0").select("scene", F.col("h").alias("common"))
    h = pairs.select(*PAIR).join(own, PAIR, "left").join(common, "scene", "left").select(*PAIR, F.coalesce("h", "common").alias("h")).filter("h IS NOT NULL")
    a = pairs.select(*PAIR, F.col("one").alias("image_id")).join(points, "image_id").drop("image_id")
    b = pairs.select(*PAIR, "image_id").join(points, "image_id").drop("image_id")
    in_two = durable(projected(a, h, pairs.select(*PAIR, "nx", "ny"), keep))
    in_one = durable(projected(b, inverse(h), pairs.select(*PAIR, F.col("nx1").alias("nx"), F.col("ny1").alias("ny")), keep).withColumnRenamed("i", "j"))

    there = in_one.select(*PAIR, "j", F.col("px").alias("x"), F.col("py").alias("y"))
    flags = match.early(match.first_match(in_two.select(*PAIR, "i", "x", "y"), there, radius, PAIR))
    strongest = Window.partitionBy(*PAIR).orderBy(F.desc("response"), "x", "y")
    cover = match.coverage(b.withColumn("i", F.row_number().over(strongest) - 1).select(*PAIR, "i", "x", "y"), coverage_points, PAIR)
    found = pairs.select(*PAIR).join(match.average_precision(flags, precision_points, PAIR), PAIR, "left").join(cover, PAIR, "left")
    # without common points nothing is repeated; without a homography the pair has failed
    known = h.select(*PAIR, F.lit(True).alias("known"))
    metrics = durable(found.join(known, PAIR, "left").select(*PAIR, F.when(F.col("known"), F.coalesce("ap", F.lit(0.0))).alias("ap"), "coverage"))

    code = F.col("descriptor") if described else F.array(F.lit(0.0))
    one = match.prefix_matches(
        in_two.select(*PAIR, "i", "x", "y", code.alias("descriptor")), in_one.select(*PAIR, "j", F.col("px").alias("x"), F.col("py").alias("y"), code.alias("descriptor")), radius, curve_points, PAIR
    )
    two = match.prefix_matches(
        in_one.select(*PAIR, F.col("j").alias("i"), "x", "y", code.alias("descriptor")), in_two.select(*PAIR, F.col("i").alias("j"), F.col("px").alias("x"), F.col("py").alias("y"), code.alias("descriptor")), radius, curve_points, PAIR
    )
    both = one.join(two.select(*PAIR, "k", F.col("repeated").alias("r2"), F.col("matched").alias("m2")), [*PAIR, "k"])
    curves = durable(both.select(*PAIR, "k", ((F.col("repeated") + F.col("r2")) * 0.5).alias("repeated"), ((F.col("matched") + F.col("m2")) * 0.5).alias("matched")))
    shown = (lambda t: t) if described else (lambda t: t.drop("matched"))
    counted = metrics.withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    return Evaluation(metrics, match.scene_summary(counted), match.overall(metrics), shown(curves), shown(match.mean_curve(curves, ["scene"])), shown(match.mean_curve(curves)))


def evaluate_folder(
    spark: SparkSession, folder: str, detector: str = "harris", kind: str = "vgg", nms: int = 8, describe: Callable[[DataFrame, DataFrame], DataFrame] | None = None, **sizes
) -> Evaluation:
    """Evaluates a detector on a dataset folder of scene folders (kinds as in readers.dataset_files).

    ``describe`` takes keypoints and rasters and adds a descriptor to each keypoint."""
    content = readers.read_files(spark, folder)
    files = readers.dataset_files(content.select("path"), kind)
    pictures = content.join(files.filter("role = 'image'").select("path"), "path", "left_semi")
    rasters = readers.decode_images(pictures)
    rasters = durable(rasters)
    bounds = rasters.groupBy("image_id").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
    images = files.filter("role = 'image'").select("scene", "number", F.col("path").alias("image_id")).join(bounds, "image_id")
    texts = content.join(files.filter("role = 'homography'").select("path"), "path", "left_semi").select(F.col("path").alias("name"), F.col("content").cast("string").alias("text"))
    h = readers.homographies(texts).join(files.select(F.col("path").alias("name"), "scene", "number"), "name").select("scene", "number", "h")
    keypoints = detect(rasters, detector, nms)
    return evaluate(images, h, describe(keypoints, rasters) if describe else keypoints, **sizes)
