"""Writers: each makes (image_id, content) or text rows; ``save`` stores contents from the executors in a folder that all of them mount, one file per row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import colour, normalise, pack, slice_volume, stretch


def _encoded(packed: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            contents = [make(np.asarray(r.data).reshape(r.ny, r.nx)) for r in pdf.itertuples()]
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": contents})

    return packed.mapInPandas(run, "image_id string, content binary")


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % a.shape[::-1] + np.clip(np.floor(a), 0, 255).astype(np.uint8).tobytes()


def encode_ppm(a: np.ndarray) -> bytes:
    """Planes of 0..1 (ny, nx, 3)."""
    return b"P6\n%d %d\n255\n" % a.shape[1::-1] + np.clip(np.floor(a * 255), 0, 255).astype(np.uint8).tobytes()


def encode_png(a: np.ndarray) -> bytes:
    """8-bit gray or colour without filters."""
    planes = np.clip(np.floor(a), 0, 255).astype(np.uint8)
    ny, nx = planes.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + planes[y].tobytes() for y in range(ny))
    header = struct.pack(">IIBBBBB", nx, ny, 8, 0 if planes.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def to_pgm(raster: DataFrame) -> DataFrame:
    """Gray files, min-max scaled to 0..255."""
    return _encoded(pack(stretch(raster)), encode_pgm)


def to_png(raster: DataFrame) -> DataFrame:
    """Gray files of the values as they are."""
    return _encoded(pack(raster), encode_png)


def to_rainbow_ppm(raster: DataFrame) -> DataFrame:
    """Colour files on the rainbow map."""
    return rgb_to_ppm(colour(normalise(raster)))


def rgb_to_ppm(rgb: DataFrame) -> DataFrame:
    """Colour files of planes in 0..1."""
    packed = rgb.groupBy("image_id").agg(
        (F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))), lambda s: F.array(s["r"], s["g"], s["b"]))).alias("data")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": [encode_ppm(np.asarray(r.data).reshape(r.ny, r.nx, 3)) for r in pdf.itertuples()]})

    return packed.mapInPandas(run, "image_id string, content binary")


def flag_colours(flags: DataFrame) -> DataFrame:
    """Flags as colours: alive black, narrow band red, far away white."""
    return flags.select(
        "image_id", "x", "y", F.when(F.col("flag") == 0, 0.0).otherwise(1.0).alias("r"), F.when(F.col("flag") == 2, 1.0).otherwise(0.0).alias("g"), F.when(F.col("flag") == 2, 1.0).otherwise(0.0).alias("b")
    )


def to_vtk(raster: DataFrame) -> DataFrame:
    """Structured points as text, values row by row (and slice by slice, for volumes)."""
    rows = F.transform("data", lambda v: v.cast("string"))
    head = F.format_string("# vtk DataFile Version 3.0\ngridloom\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS %d %d %d\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA %d\nSCALARS v float 1\nLOOKUP_TABLE default\n", F.col("nx"), F.col("ny"), F.col("nz"), F.size("data"))
    return pack(raster).select("image_id", F.encode(F.concat(head, F.array_join(rows, " "), F.lit("\n")), "UTF-8").alias("content"))


def slice_to_ppm(volume: DataFrame, axis: str, at: int) -> DataFrame:
    """A volume's slice as a colour file on the rainbow map."""
    return to_rainbow_ppm(slice_volume(volume, axis, at))


def to_ascii(raster: DataFrame) -> DataFrame:
    """dimX dimY dimZ, then the values, of rasters and volumes."""
    rows = F.array_join(F.transform("data", lambda v: v.cast("string")), " ")
    return pack(raster).select("image_id", F.encode(F.concat_ws(" ", "nx", "ny", "nz", rows), "UTF-8").alias("content"))


def homography_text(h: DataFrame) -> DataFrame:
    """Three lines of three numbers."""
    line = lambda i: F.concat_ws(" ", *[F.col("h")[i + k].cast("string") for k in range(3)])
    return h.select("name", F.concat_ws("\n", line(0), line(3), line(6)).alias("text"))


def curve_lines(curve: DataFrame, name: str, value: str = "repeated") -> DataFrame:
    """A curve file: the detector's name, then the values by k, each followed by a comma."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(value).alias("v")))), lambda s: F.concat(s["v"].cast("string"), F.lit(",")))
    body = curve.agg(F.array_join(cells, "").alias("text")).select(F.lit(1).alias("line_no"), "text")
    return curve.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.lit(name).alias("text")).unionByName(body)


def scene_lines(summary: DataFrame, name: str) -> DataFrame:
    """The summary file: name, 'scene,map' lines, the total, an empty line, a heading and 'scene,coverage' lines."""
    spark = summary.sparkSession
    order = Window.partitionBy("part").orderBy("scene")
    maps = summary.filter("scene <> 'Total'").select(F.lit(1).alias("part"), "scene", F.concat_ws(",", "scene", F.col("map").cast("string")).alias("text"))
    total = summary.filter("scene = 'Total'").select(F.lit(2).alias("part"), "scene", F.concat_ws(",", "scene", F.col("map").cast("string")).alias("text"))
    cover = summary.filter("scene <> 'Total'").select(F.lit(4).alias("part"), "scene", F.concat_ws(",", "scene", F.col("coverage").cast("string")).alias("text"))
    fixed = spark.createDataFrame([(0, "", name), (3, "a", ""), (3, "b", "coverage values")], "part int, scene string, text string")
    lines = fixed.unionByName(maps).unionByName(total).unionByName(cover)
    return lines.select("part", F.row_number().over(order).alias("line_no"), "text")


def save(contents: DataFrame, folder: str, suffix: str) -> None:
    """Stores each content as folder/image_id + suffix. ``folder`` is a path that every executor mounts or a URI of a file
    system that Arrow knows (file, hdfs, s3, gs); another scheme is an error."""

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        files, target = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(target, recursive=True)
        for r in rows:
            part = f"{target}/.{r['image_id']}.part"
            with files.open_output_stream(part) as f:
                f.write(bytes(r["content"]))
            files.move(part, f"{target}/{r['image_id']}{suffix}")  # a repeated task writes the same file

    contents.foreachPartition(put)
