"""Front propagation on rasters: fast marching distances with the nearest boundary point carried along. One kernel call per image."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import to_array
from gridloom.operators.trace import arc_lengths, edge_pixels

FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))


def march(inside: np.ndarray, method: str = "one_point") -> tuple[np.ndarray, np.ndarray]:
    """Distance of inside pixels to the edge by the upwind scheme, and the flat index of the edge pixel each stems from (-1 outside).

    Methods: ``one_point`` keeps the origin of the neighbour that came first; ``star`` takes the nearest of the origins
    of all 8 neighbours already passed (and its exact distance); ``averaging`` is upwind distance with star origins."""
    ny, nx = inside.shape
    edge = edge_pixels(inside)
    dist = np.where(inside, np.inf, 0.0)
    origin = np.full((ny, nx), -1, dtype=np.int64)
    done = ~inside
    heap = []
    for y, x in zip(*np.nonzero(edge), strict=True):
        dist[y, x], origin[y, x] = 0.0, y * nx + x
        heapq.heappush(heap, (0.0, int(y), int(x)))
    passed = np.zeros((ny, nx), dtype=bool)

    def solve(y: int, x: int) -> float:
        best = []
        for a, b in (((0, 1), (0, -1)), ((1, 0), (-1, 0))):
            near = [dist[y + dy, x + dx] for dy, dx in (a, b) if 0 <= y + dy < ny and 0 <= x + dx < nx and passed[y + dy, x + dx]]
            best.append(min(near, default=np.inf))
        u, v = min(best), max(best)
        if not np.isfinite(v) or v - u >= 1:
            return u + 1
        return (u + v + np.sqrt(2 - (u - v) ** 2)) / 2

    while heap:
        d, y, x = heapq.heappop(heap)
        if passed[y, x]:
            continue
        passed[y, x] = True
        for dx, dy in FOUR:
            v, u = y + dy, x + dx
            if 0 <= v < ny and 0 <= u < nx and not done[v, u] and not passed[v, u]:
                new = solve(v, u)
                source = origin[y, x]
                if method != "one_point":
                    around = {origin[v + b, u + a] for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= v + b < ny and 0 <= u + a < nx and passed[v + b, u + a]} - {-1}
                    source = min(around, key=lambda o: ((o // nx - v) ** 2 + (o % nx - u) ** 2, o))
                    if method == "star":
                        new = float(np.hypot(source // nx - v, source % nx - u))
                if new < dist[v, u]:
                    dist[v, u], origin[v, u] = new, source
                    heapq.heappush(heap, (new, v, u))
    return dist, origin


def edge_labels(inside: np.ndarray, per_component: bool = False, bottom_up: bool = False) -> np.ndarray:
    """Edge pixels numbered by arc length, or by the number of their boundary."""
    lengths, _ = arc_lengths(inside, bottom_up)
    if not per_component:
        return lengths
    order = np.unique(lengths[lengths > 0])
    starts = order[np.flatnonzero(np.diff(order, prepend=-1e9) > 2)]
    return np.where(lengths > 0, np.searchsorted(starts, lengths, side="right"), 0)


def distances(df: DataFrame, threshold: float, method: str = "star") -> DataFrame:
    """image_id, x, y, dt, ox, oy: marched distance of the pixels at or above the threshold and the edge pixel each stems from."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, o = march(to_array(pdf, fill=-np.inf) >= threshold, method)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        at, nx = o[y, x], d.shape[1]
        keep = at >= 0
        return pd.DataFrame({"image_id": pdf["image_id"][keep], "x": x[keep], "y": y[keep], "dt": d[y, x][keep], "ox": (at % nx)[keep], "oy": (at // nx)[keep]})

    return df.select("image_id", "x", "y", "v").groupBy("image_id").applyInPandas(run, "image_id string, x int, y int, dt double, ox int, oy int")


def skeleton_distance(df: DataFrame, skeleton: DataFrame, threshold: float) -> DataFrame:
    """Distances to a skeleton (image_id, x, y) inside a shape, and sqrt(b) with b the share of the way from the skeleton to the edge."""
    marked = df.join(skeleton.select("image_id", "x", "y", F.lit(True).alias("on")), ["image_id", "x", "y"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        on = to_array(pdf.assign(on=pdf["on"].notna().astype(float)), "on") > 0
        inside = to_array(pdf, fill=-np.inf) >= threshold
        dt, _ = march(inside, "star")
        ys, xs = np.nonzero(on)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        away = np.full(len(pdf), np.nan)
        if len(xs):
            away = np.array([np.sqrt(((xs - a) ** 2 + (ys - b) ** 2).min()) for a, b in zip(x, y, strict=True)])
        whole = dt[y, x] + away
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(whole > 0, dt[y, x] / whole, 0.0)
        keep = inside[y, x]
        return pd.DataFrame({"image_id": pdf["image_id"][keep], "x": x[keep], "y": y[keep], "skeleton_dt": away[keep], "root_b": np.sqrt(np.clip(share, 0, 1))[keep]})

    return marked.select("image_id", "x", "y", "v", "on").groupBy("image_id").applyInPandas(run, "image_id string, x int, y int, skeleton_dt double, root_b double")


def eigen_symmetric(df: DataFrame, matrix: str) -> DataFrame:
    """Adds values (descending) and vectors (rows) of symmetric matrices given as arrays of rows."""

    @F.pandas_udf("values array<double>, vectors array<array<double>>")
    def run(m: pd.Series) -> pd.DataFrame:
        found = [np.linalg.eigh(np.array([list(r) for r in a])) for a in m]
        return pd.DataFrame({"values": [w[::-1].tolist() for w, _ in found], "vectors": [v.T[::-1].tolist() for _, v in found]})

    return df.withColumn("eigen", run(F.col(matrix)))


def eigenvalues_2x2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Larger and smaller eigenvalue of ((a, b), (b, c))."""
    mid, half = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    return mid + half, mid - half
