"""gridloom: raster, keypoint, signal and byte analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
