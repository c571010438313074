"""Corner detectors by name: each takes a dense raster and a suppression window and returns keypoints ranked by response.

``Detector`` is the extension point: any function of that shape can be registered, also one that reads keypoints made
elsewhere. ``detect`` adds the limit that most detectors observe."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.keypoints import size_from_endpoints, top_n
from gridloom.operators.stencil import fast_corners, harris_response, suppress
from gridloom.operators.trace import endpoint_density, endpoints, skeleton_corners

KEY = ["image_id", "x", "y"]


class Detector(Protocol):
    def __call__(self, raster: DataFrame, nms: int) -> DataFrame: ...


DETECTORS: dict[str, Detector] = {}


def register(name: str):
    def put(f: Detector) -> Detector:
        DETECTORS[name] = f
        return f

    return put


def _thinned(response: DataFrame, raster: DataFrame, nms: int) -> DataFrame:
    dense = raster.select(*KEY).join(response.select(*KEY, "v"), KEY, "left").withColumn("v", F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)))
    return top_n(suppress(dense, nms).withColumnRenamed("v", "response"), None)


@register("skeleton")
def skeleton(raster: DataFrame, nms: int = 8) -> DataFrame:
    return skeleton_corners(raster, nms=nms)


@register("skeleton_scale")
def skeleton_scale(raster: DataFrame, nms: int = 8, saliency: float = 1.6, step: int = 1, margin: int = 10) -> DataFrame:
    """Without blur; a keypoint's size is the mean branch length of the ends at it."""
    ends = endpoints(raster, saliency, step, margin)
    return size_from_endpoints(_thinned(endpoint_density(raster, ends), raster, nms), ends)


@register("harris")
def harris(raster: DataFrame, nms: int = 8) -> DataFrame:
    return _thinned(harris_response(raster), raster, nms)


@register("fast")
def fast(raster: DataFrame, nms: int = 8, limit: float = 6.0) -> DataFrame:
    return _thinned(fast_corners(raster, limit), raster, nms)


def detect(raster: DataFrame, name: str, nms: int = 8, n: int | None = None) -> DataFrame:
    found = DETECTORS[name](raster, nms)
    return found if n is None else found.filter(F.col("rank") <= n)
