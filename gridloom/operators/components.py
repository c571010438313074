"""Connected components of rasters and what is made from them.

An image (or an image's layer) is one group of at most about a million pixels, so labels are made by an Arrow
kernel per group; groups are spread over the cluster. ``propagate`` is the form for sparse pixel sets of any size: the
kernel labels square tiles, and joins carry the labels across their borders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import durable


def label_array(values: np.ndarray, eight: bool = True, same: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.equal) -> np.ndarray:
    """Component numbers (0, 1, ... in the order of their first pixels, row by row) of equal neighbouring values; every value is labelled."""
    ny, nx = values.shape
    index = np.arange(nx * ny).reshape(ny, nx)
    steps = [(slice(None), slice(None, -1), slice(None), slice(1, None)), (slice(None, -1), slice(None), slice(1, None), slice(None))]
    if eight:
        steps += [(slice(None, -1), slice(None, -1), slice(1, None), slice(1, None)), (slice(None, -1), slice(1, None), slice(1, None), slice(None, -1))]
    pairs = []
    for a, b, c, d in steps:
        joined = same(values[a, b], values[c, d])
        pairs.append((index[a, b][joined], index[c, d][joined]))
    u, v = (np.concatenate(p) for p in zip(*pairs, strict=True))
    return np.unique(_roots(nx * ny, u, v), return_inverse=True)[1].reshape(ny, nx)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each is linked with by the pairs u, v."""
    root = np.arange(n)
    while True:  # hook roots to smaller neighbours, then halve the paths
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root


def to_array(pdf: pd.DataFrame, value: str = "v", fill: float = 0.0) -> np.ndarray:
    out = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), fill, dtype=np.float64)
    out[pdf["y"], pdf["x"]] = pdf[value]
    return out


def label(df: DataFrame, eight: bool = True, same: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.equal) -> DataFrame:
    """Adds component: (image_id, x, y, v, component) of dense rasters; neighbours are joined where ``same`` (of two arrays of values, symmetric) holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(component=label_array(to_array(pdf), eight, same)[pdf["y"], pdf["x"]])

    return df.select("image_id", "x", "y", "v").groupBy("image_id").applyInPandas(run, "image_id string, x int, y int, v double, component int")


TILE_BITS = 9


def _first_points(v: np.ndarray, x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each of the points the x and y of its component's first point, row by row; steps are half of the neighbourhood."""
    value = np.unique(v, return_inverse=True)[1].astype(np.int64)
    left, upper = int(x.min()) - 1, int(y.min()) - 1  # so that no step leaves its row or value
    nx, ny = int(x.max()) - left + 2, int(y.max()) - upper + 2
    keys, at = np.unique((value * ny + y - upper) * nx + x - left, return_inverse=True)
    pairs = []
    for dx, dy in steps:
        wanted = keys + dy * nx + dx
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = (keys[place] == wanted).nonzero()[0]
        pairs.append((found, place[found]))
    first = keys[_roots(len(keys), *(np.concatenate(p) for p in zip(*pairs, strict=True)))[at]]
    return first % nx + left, first // nx % ny + upper


def propagate(points: DataFrame, eight: bool = True) -> DataFrame:
    """Components of sparse points (image_id, x, y, v) of equal v; the component is the first point's row-major key.

    Tiles of 512 x 512 are labelled by the kernel; then linked labels of neighbouring tiles are brought together in rounds whose
    number grows with the logarithm of their count, checkpointed in the shared folder. Points in one tile take no round."""
    steps = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if eight else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = _first_points(pdf["v"].to_numpy(), pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64), steps)
        return pdf.drop(columns=["tx", "ty"]).assign(x0=x0, y0=y0)

    tile = [F.shiftright("x", TILE_BITS).alias("tx"), F.shiftright("y", TILE_BITS).alias("ty")]
    whole = points.filter("image_id is not null and x is not null and y is not null and v is not null")
    kinds = dict(points.dtypes)
    schema = f"image_id {kinds['image_id']}, x {kinds['x']}, y {kinds['y']}, v {kinds['v']}, x0 long, y0 long"
    labelled = durable(whole.select("image_id", "x", "y", "v", *tile).groupBy("image_id", "tx", "ty").applyInPandas(run, schema))
    node = F.struct("image_id", "v", "y0", "x0")
    edge = " or ".join(f"({c} & {(1 << TILE_BITS) - 1}) in (0, {(1 << TILE_BITS) - 1})" for c in "xy")
    border = labelled.filter(edge).select("image_id", "v", "x", "y", node.alias("a"), *tile)
    reached = border.select("image_id", "v", "a", "tx", "ty", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("o"))
    outside = reached.select("image_id", "v", "o.x", "o.y", "a", "tx", "ty").filter(f"shiftright(x, {TILE_BITS}) != tx or shiftright(y, {TILE_BITS}) != ty").drop("tx", "ty")
    links = durable(outside.join(border.select("image_id", "v", "x", "y", F.col("a").alias("b")), ["image_id", "v", "x", "y"]).select("a", "b").distinct())
    key = F.col("y0") * 1048576 + F.col("x0")
    if links.isEmpty():
        return labelled.select("image_id", "x", "y", "v", key.alias("component"))
    from gridloom.llm.components import components

    joined = labelled.withColumn("node", node).join(components(links), "node", "left")
    return joined.select("image_id", "x", "y", "v", F.coalesce(F.col("component.y0") * 1048576 + F.col("component.x0"), key).alias("component"))


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id", "component").agg(F.count("*").alias("n"), F.first("v").alias("v"))


def drop_small(labelled: DataFrame, least: int) -> DataFrame:
    """Pixels of components with at least so many pixels."""
    big = sizes(labelled).filter(F.col("n") >= least).select("image_id", "component")
    return labelled.join(big, ["image_id", "component"], "left_semi")


def without_islands(a: np.ndarray, percent: float) -> np.ndarray:
    """Gray raster with small components of every level set flipped: a pixel's largest level at which it is still foreground.

    Level sets only change at gray values present, so each distinct set is labelled once, at the largest level it stands for."""
    out = np.zeros_like(a)
    least = percent / 100.0 * a.size
    values = np.unique(a.astype(np.int64))
    for level in sorted({min(int(v), 254) for v in values} | {254}):
        fg = a >= level
        lab = label_array(fg)
        n = np.bincount(lab.ravel())
        kept = np.where((n >= least)[lab], fg, ~fg)
        out[kept] = np.maximum(out[kept], level)
    return out


def remove_islands(df: DataFrame, percent: float = 0.05) -> DataFrame:
    """Islands smaller than a percentage of the image are removed at every gray level; values end at 254."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(v=without_islands(to_array(pdf), percent)[pdf["y"], pdf["x"]])

    return df.select("image_id", "x", "y", "v").groupBy("image_id").applyInPandas(run, "image_id string, x int, y int, v double")


def remove_layer_islands(layer: DataFrame, percent: int) -> DataFrame:
    """One binary layer (v > 0 is foreground): components under a whole percentage of the image are flipped to 0 or 255."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fg = to_array(pdf) > 0
        lab = label_array(fg)
        small = np.bincount(lab.ravel())[lab] < percent / 100.0 * fg.size
        return pdf.assign(v=np.where(fg ^ small, 255.0, 0.0)[pdf["y"], pdf["x"]])

    return layer.select("image_id", "x", "y", "v").groupBy("image_id").applyInPandas(run, "image_id string, x int, y int, v double")


def strongest_per_component(df: DataFrame) -> DataFrame:
    """From (image_id, x, y, component, importance, skeleton): the skeleton pixel of largest positive importance of each component, first in rows on ties."""
    best = F.min_by(F.struct("x", "y", "importance"), F.struct(-F.col("importance"), "y", "x"))
    found = df.filter("skeleton and importance > 0").groupBy("image_id", "component").agg(best.alias("b"))
    return found.select("image_id", "component", "b.*")


def seed_component(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pixels of the components that hold the seeds (image_id, x, y)."""
    wanted = labelled.join(seeds.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi").select("image_id", "component").distinct()
    return labelled.join(wanted, ["image_id", "component"], "left_semi")


def seed_points(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """What a flood from the seeds reaches as one list per image: image_id, points (x, y in rows)."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("y", "x"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return seed_component(labelled, seeds).groupBy("image_id").agg(points.alias("points"))
