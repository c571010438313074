"""Streams of raster pixels: the corner query per micro-batch. An addition of this library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.keypoints import top_n
from gridloom.operators.stencil import density_blur, local_maxima


def corners_of_batch(raster: DataFrame, window: int = 8, n: int = 20) -> DataFrame:
    """The n strongest density maxima of each image of a batch of whole, dense images."""
    maxima = local_maxima(density_blur(raster), window, value="weighted")
    return top_n(maxima.withColumn("response", maxima["weighted"].cast("double")), n).select("image_id", "rank", "x", "y", "weighted")


def stream_corners(pixels: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Runs the corner query on each micro-batch of a stream of (image_id, x, y, v) rows, whole images per batch, and hands results to ``sink`` (results, batch id)."""
    return pixels.writeStream.foreachBatch(lambda batch, i: sink(corners_of_batch(batch, **options), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
