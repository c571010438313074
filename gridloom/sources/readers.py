"""Readers: image, volume, sound, homography, configuration and result files as DataFrames.

Files come in by Spark's ``binaryFile`` or ``text`` readers, so any filesystem works; decoding runs in Arrow batches
on (path, content) rows and gives one packed row per image, which ``raster.unpack`` turns into pixels."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators.raster import unpack


def sniff(content: Column) -> Column:
    """File type by the first bytes: vtk, pgm, ppm, bmp, png, wav, else ascii."""
    head = F.decode(F.substring(content, 1, 4), "ISO-8859-1")
    two = F.substring(head, 1, 2)
    return (
        F.when(F.substring(head, 1, 1) == "#", "vtk")
        .when(two == "P5", "pgm")
        .when(two == "P6", "ppm")
        .when(two == "BM", "bmp")
        .when(head == "\x89PNG", "png")
        .when(head == "RIFF", "wav")
        .otherwise("ascii")
    )


def _pnm_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, maximum and offset of the pixels of a P5 or P6 file; # starts a comment."""
    numbers, at = [], 2
    while len(numbers) < 3:
        m = re.compile(rb"\s*(#[^\n]*\n|\d+)").match(data, at)
        if m is None:
            raise ValueError("bad image header")
        if not m[1].startswith(b"#"):
            numbers.append(int(m[1]))
        at = m.end()
    return numbers[0], numbers[1], numbers[2], at + 1


def decode_pgm(data: bytes) -> np.ndarray:
    nx, ny, _, at = _pnm_header(data)
    return np.frombuffer(data, np.uint8, nx * ny, at).reshape(ny, nx).astype(float)


def decode_ppm(data: bytes) -> np.ndarray:
    """Red, green and blue planes, scaled by 1 / maximum."""
    nx, ny, most, at = _pnm_header(data)
    return np.frombuffer(data, np.uint8, nx * ny * 3, at).reshape(ny, nx, 3) / most


def decode_bmp(data: bytes) -> np.ndarray:
    """Gray of 8-bit pixels, or the mean of 24-bit colours; rows in file order, padded to four bytes."""
    at, nx, ny, bits = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0]
    ny = abs(ny)
    width = nx * bits // 8
    rows = np.frombuffer(data, np.uint8, (width + 3) // 4 * 4 * ny, at).reshape(ny, -1)[:, :width]
    return rows.astype(float) if bits == 8 else rows.reshape(ny, nx, 3).astype(float).sum(axis=2) / 3


def decode_vtk(data: bytes) -> np.ndarray:
    """Structured points: dimensions, then the values after the lookup table line; a volume has more than one slice."""
    text = data.decode("latin-1")
    dims = [int(v) for v in re.search(r"DIMENSIONS\s+(\d+)\s+(\d+)\s+(\d+)", text).groups()]
    values = np.array(text[re.search(r"LOOKUP_TABLE[^\n]*\n", text).end() :].split(), dtype=float)
    out = values[: dims[0] * dims[1] * dims[2]].reshape(dims[2], dims[1], dims[0])
    return out[0] if dims[2] == 1 else out


def decode_ascii(data: bytes) -> np.ndarray:
    """dimX dimY dimZ, then the values."""
    v = np.array(data.decode("latin-1").split(), dtype=float)
    nx, ny, nz = (int(n) for n in v[:3])
    out = v[3 : 3 + nx * ny * nz].reshape(nz, ny, nx)
    return out[0] if nz == 1 else out


def png_chunks(data: bytes) -> list[tuple[str, int, bool, bytes]]:
    """Type, length, whether the checksum holds, and content of each chunk."""
    out, at = [], 8
    while at + 12 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        out.append((kind.decode("latin-1"), n, zlib.crc32(kind + body) == struct.unpack_from(">I", data, at + 8 + n)[0], body))
        at += 12 + n
    return out


def _unfilter(raw: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Scanlines without their filters."""
    out = np.zeros((rows + 1, width + step), dtype=np.int64)
    at = 0
    for y in range(rows):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, width, at + 1).astype(np.int64)
        at += width + 1
        up, now = out[y], out[y + 1]
        if kind in (0, 2):
            now[step:] = line + (up[step:] if kind == 2 else 0) & 255
            continue
        for x in range(width):
            a, b, c = int(now[x]), int(up[x + step]), int(up[x])
            if kind == 4:
                p = a + b - c
                guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            else:
                guess = a if kind == 1 else (a + b) // 2
            now[x + step] = int(line[x]) + guess & 255
    return out[1:, step:].astype(np.uint8)


# First column and row, and steps, of the seven interlace passes.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> np.ndarray:
    """Gray or colour planes (8 bits; palettes are looked up; interlaced files too), alpha left out."""
    chunks = png_chunks(data)
    if not all(ok for _, _, ok, _ in chunks):
        raise ValueError("checksum of a chunk is wrong")
    nx, ny, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", chunks[0][3])
    if depth != 8:
        raise ValueError("only 8-bit images are read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, at = zlib.decompress(b"".join(body for kind, _, _, body in chunks if kind == "IDAT")), 0
    out = np.zeros((ny, nx, n), dtype=np.uint8)
    for x0, y0, dx, dy in ADAM7 if laced else ((0, 0, 1, 1),):
        w, h = -(-(nx - x0) // dx), -(-(ny - y0) // dy)
        if w > 0 and h > 0:
            out[y0::dy, x0::dx] = _unfilter(raw[at:], h, w * n, n).reshape(h, w, n)
            at += h * (w * n + 1)
    if colour == 3:
        palette = np.frombuffer(next(body for kind, _, _, body in chunks if kind == "PLTE"), np.uint8).reshape(-1, 3)
        return palette[out[:, :, 0]].astype(float)
    return (out[:, :, 0] if n < 3 else out[:, :, :3]).astype(float)


def gray(planes: np.ndarray) -> np.ndarray:
    """0.299 R + 0.587 G + 0.114 B, rounded."""
    return np.floor(planes @ np.array([0.299, 0.587, 0.114]) + 0.5)


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {
    "pgm": decode_pgm, "ppm": decode_ppm, "bmp": decode_bmp, "vtk": decode_vtk, "ascii": decode_ascii, "png": decode_png,
}


def _decoded(files: DataFrame, make: Callable[[str, bytes], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(path, *row) for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True) for row in make(kind, bytes(content))]
            yield pd.DataFrame(rows, columns=["image_id", *names])

    return files.select("path", sniff(F.col("content")).alias("kind"), "content").mapInPandas(run, schema)


def decode_images(files: DataFrame) -> DataFrame:
    """Gray rasters of (path, content) rows; the path is the image's name. Colours become gray."""

    def make(kind: str, data: bytes) -> list[tuple]:
        a = DECODERS[kind](data)
        a = gray(a * (255.0 if kind == "ppm" else 1.0)) if a.ndim == 3 and a.shape[2] == 3 and kind in ("ppm", "png") else a
        return [(a.shape[1], a.shape[0], a.ravel().tolist())]

    return unpack(_decoded(files, make, "image_id string, nx int, ny int, data array<double>", ["nx", "ny", "data"]))


def decode_rgb(files: DataFrame) -> DataFrame:
    """Colour planes (image_id, x, y, r, g, b) of ppm and png files."""

    def make(kind: str, data: bytes) -> list[tuple]:
        a = DECODERS[kind](data)
        a = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a
        return [(a.shape[1], a.reshape(-1, 3).tolist())]

    packed = _decoded(files, make, "image_id string, nx int, data array<array<double>>", ["nx", "data"])
    rows = packed.select("image_id", "nx", F.posexplode("data").alias("i", "p"))
    return rows.select("image_id", (F.col("i") % F.col("nx")).alias("x"), F.expr("cast(i div nx as int)").alias("y"), F.col("p")[0].alias("r"), F.col("p")[1].alias("g"), F.col("p")[2].alias("b"))


def decode_volumes(files: DataFrame) -> DataFrame:
    """Volumes (image_id, x, y, z, v) of vtk, ascii and pgm files."""

    def make(kind: str, data: bytes) -> list[tuple]:
        a = DECODERS[kind](data)
        a = a[None] if a.ndim == 2 else a
        return [(z, a.shape[2], a.shape[1], plane.ravel().tolist()) for z, plane in enumerate(a)]

    packed = _decoded(files, make, "image_id string, z int, nx int, ny int, data array<double>", ["z", "nx", "ny", "data"])
    rows = packed.select("image_id", "z", "nx", F.posexplode("data").alias("i", "v"))
    return rows.select("image_id", (F.col("i") % F.col("nx")).alias("x"), F.expr("cast(i div nx as int)").alias("y"), "z", "v")


def decode_wav(files: DataFrame) -> DataFrame:
    """16-bit samples of a 44-byte-header file, channels apart: series_id 'path:channel', idx, v."""

    def make(kind: str, data: bytes) -> list[tuple]:
        channels = struct.unpack_from("<H", data, 22)[0]
        v = np.frombuffer(data, "<i2", (len(data) - 44) // 2, 44)
        return [(c, v[c::channels].astype(float).tolist()) for c in range(channels)]

    packed = _decoded(files, make, "image_id string, channel int, data array<double>", ["channel", "data"])
    return packed.select(F.concat_ws(":", "image_id", "channel").alias("series_id"), F.posexplode("data").alias("idx", "v"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files under a folder, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return decode_images(read_files(spark, path, glob))


def homographies(texts: DataFrame) -> DataFrame:
    """Nine numbers apart by white space, from (name, text): name, h."""
    return texts.select("name", F.transform(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda v: v.try_cast("double")).alias("h")).filter(F.size("h") == 9)


def dataset_files(paths: DataFrame, kind: str) -> DataFrame:
    """Scene folders from a column path '.../scene/file': scene, path, role (image, homography, other) and number.

    kind: vgg, hp, ef or webcam. An image's number ends its stem; a homography's is its stem's (a name without extension is
    its own stem) last character for hp, 0 (all images) for webcam and the last but one otherwise."""
    parts = F.split("path", "/")
    name, scene = F.element_at(parts, -1), F.element_at(parts, -2)
    ext = F.lower(scalar.file_extension(name))
    stem = F.when(ext == "", name).otherwise(scalar.file_stem(name))
    image = ext.isin("ppm", "pgm", "png", "jpg", "jpeg", "bmp")
    other = {"hp": F.substring(stem, -1, 1), "webcam": F.lit("0")}.get(kind, F.substring(stem, -2, 1))
    text = (ext == "txt") | (ext == "") | stem.startswith("H")
    role = F.when(image, "image").when(text & (name != "n.txt"), "homography").otherwise("other")
    return paths.select(scene.alias("scene"), "path", role.alias("role"), F.when(image, scalar.trailing_number(stem)).when(role == "homography", other.try_cast("int")).alias("number"))


def scene_sizes(scenes: DataFrame, counts: DataFrame) -> DataFrame:
    """Images per scene: as its n.txt says (scene, n), else 6."""
    return scenes.join(counts, "scene", "left").select("scene", F.coalesce("n", F.lit(6)).alias("n"))


def config(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Settings with dotted names: 'name = value', 'name = (' opens a group and ')' ends it, # comments, %name% inserts a setting or environment value."""
    known: dict[str, str] = {}
    path: list[str] = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line == ")":
            path.pop()
        elif "=" in line:
            name, value = (p.strip() for p in line.split("=", 1))
            if value == "(":
                path.append(name)
                continue
            full = lambda n, k: ".".join([*path[:k], n])

            def insert(m: re.Match, full=full) -> str:
                for k in range(len(path), -1, -1):
                    if full(m[1], k) in known:
                        return known[full(m[1], k)]
                return (environment or {}).get(m[1], m[0])

            known[".".join([*path, name])] = re.sub(r"%([^%]+)%", insert, value)
    return known


def setting(values: Column, name: str, kind: str = "string") -> Column:
    """A typed setting of a map column: string, bool (yes and true hold), double or int; null if absent."""
    v = F.try_element_at(values, F.lit(name))
    return F.lower(v).isin("yes", "true") if kind == "bool" else v.try_cast(kind)


def read_results(lines: DataFrame) -> DataFrame:
    """Curve files as rows (file, line_no from 0, text): detector (first line), and k, value of the number list, whose trailing comma ends it."""
    head = lines.filter("line_no = 0").select("file", F.col("text").alias("detector"))
    cells = lines.filter("line_no > 0").select("file", "line_no", F.posexplode(F.split("text", ",")).alias("k", "cell"))
    cells = cells.select("file", "line_no", (F.col("k") + 1).alias("k"), F.trim("cell").try_cast("double").alias("value")).filter("value is not null")
    return cells.join(head, "file")


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs compare as numbers: array of (text, number)."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), "").otherwise(p).alias("text"), F.when(p.rlike(r"^\d"), p.try_cast("decimal(38,0)")).alias("number")))
