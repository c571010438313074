"""Skeleton endpoints of every gray level: boundary lengths, nearest sites, skeleton, tracing.

Tracing depends on order and marks what it has seen, so each (image, level) is one kernel call on arrays of at most
about a million pixels. Images are packed to one row, then dealt out by (image, level). Neighbouring levels with
the same layer are computed once and carry the number of levels they stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import label_array
from gridloom.operators.raster import pack
from gridloom.operators.stencil import density_blur, densify, local_maxima, suppress

JUMP = 1000.0  # between the lengths of disjoint boundaries
CELLS = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def edge_pixels(fg: np.ndarray) -> np.ndarray:
    """Foreground pixels with a background 4-neighbour; outside counts as background."""
    p = np.pad(fg, 1)
    return fg & ~(p[1:-1, :-2] & p[1:-1, 2:] & p[:-2, 1:-1] & p[2:, 1:-1])


def arc_lengths(fg: np.ndarray, bottom_up: bool = False) -> tuple[np.ndarray, float]:
    """Length along the boundary at each edge pixel (0 elsewhere), and the largest; a boundary that touches no labelled pixel starts JUMP further on."""
    ny, nx = fg.shape
    edge = edge_pixels(fg)
    out = np.zeros((ny, nx))
    ys, xs = np.nonzero(edge)
    todo = list(zip(xs.tolist(), ys.tolist(), strict=True))
    if not bottom_up:
        todo.sort(key=lambda p: (-p[1], p[0]))
    length = 1.0 - JUMP
    while todo:
        x, y = todo.pop()
        if out[y, x] > 0:
            continue
        least, at = 0.0, None
        fresh = []
        for dx, dy in CELLS:
            u, v = x + dx, y + dy
            if 0 <= u < nx and 0 <= v < ny:
                known = out[v, u]
                if known > 0 and (least == 0 or known <= least):
                    least, at = known, (u, v)
                if known == 0 and edge[v, u] and (dx or dy):
                    fresh.append((u, v))
        out[y, x] = length + JUMP if at is None else least + float(np.hypot(x - at[0], y - at[1]))
        length = max(length, out[y, x])
        todo += fresh
    return out, length


def nearest(sites: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance, column and row of each pixel's nearest site; exact, by columns, then rows."""
    ny, nx = sites.shape
    rows = np.arange(ny)[:, None]
    up = np.maximum.accumulate(np.where(sites, rows, -(10**6)), axis=0)
    down = np.minimum.accumulate(np.where(sites, rows, 10**6)[::-1], axis=0)[::-1]
    cy = np.where(rows - up <= down - rows, up, down)
    gap = (rows - cy).astype(np.int64) ** 2
    dx2 = (np.arange(nx)[:, None] - np.arange(nx)[None, :]) ** 2
    d2, sx = np.empty((ny, nx), dtype=np.int64), np.empty((ny, nx), dtype=np.int64)
    for y in range(ny):
        all_columns = dx2 + gap[y][None, :]
        sx[y] = all_columns.argmin(axis=1)
        d2[y] = all_columns.min(axis=1)
    return d2, sx, np.take_along_axis(cy, sx, axis=1)


def skeleton_field(fg: np.ndarray, saliency: float, bottom_up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Skeleton mask, importance and distance of one layer and scan direction."""
    labels, length = arc_lengths(fg, bottom_up)
    mask, imp = np.zeros(fg.shape, dtype=bool), np.zeros(fg.shape)
    if not (labels > 0).any():
        return mask, imp, np.zeros(fg.shape)
    d2, sx, sy = nearest(labels > 0)
    dt = np.sqrt(d2)
    own = labels[sy, sx]
    ny, nx = fg.shape
    inner = np.zeros(fg.shape, dtype=bool)
    inner[1 : ny - 2, 1 : nx - 2] = True
    top = np.zeros(fg.shape)
    mid = own[1:-1, 1:-1]
    if mid.size:
        top[1:-1, 1:-1] = np.max([np.abs(mid - own[1:-1, :-2]), np.abs(mid - own[1:-1, 2:]), np.abs(mid - own[:-2, 1:-1]), np.abs(mid - own[2:, 1:-1])], axis=0)
    imp = np.where(inner & (d2 > 0), np.minimum(top, np.abs(length - top)), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mask = inner & (d2 > 0) & (imp / dt >= saliency) & (imp > 1) & ~((imp < 5) & (dt < 1.5))
    return mask, imp, dt


def start_points(fg: np.ndarray, mask: np.ndarray, imp: np.ndarray) -> list[tuple[int, int]]:
    """Of each 4-connected component of fore- and background the skeleton pixel of largest importance (whole numbers, first in rows on ties)."""
    labels = label_array(fg, eight=False)
    out = []
    ys, xs = np.nonzero(mask & (imp > 0))
    best: dict[int, tuple[float, int, int]] = {}
    for y, x in zip(ys.tolist(), xs.tolist(), strict=True):
        k, held = int(labels[y, x]), best.get(int(labels[y, x]))
        if held is None or imp[y, x] > held[0]:
            best[k] = (float(int(imp[y, x])), x, y)
    for k in sorted(best):
        if best[k][0] > 0:
            out.append(best[k][1:])
    return out


def clusters(pixels: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """8-connected groups, in the order of their first pixels by x, then y."""
    left, out = sorted(pixels), []
    while left:
        group, grown = [left.pop(0)], True
        while grown:
            near = [p for p in left if any(abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 for q in group)]
            grown = bool(near)
            group += near
            left = [p for p in left if p not in near]
        out.append(sorted(group))
    return out


def _centre(node: list[tuple[int, int]]) -> tuple[int, int]:
    n = len(node)
    return int(np.floor(sum(p[0] for p in node) / n + 0.5)), int(np.floor(sum(p[1] for p in node) / n + 0.5))


def trace(mask: np.ndarray, starts: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, float]], list[tuple[int, int, int]]]:
    """Walks the skeleton depth first from the start points.

    Returns vertices (label -1 start, 0 junction, 1 end; x, y; for ends the branch's length) and edges (from, to, length).
    A place with more than two neighbouring clusters is a junction; one whose only neighbour has been seen is an end."""
    ny, nx = mask.shape
    on = {(int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)}
    seen: set[tuple[int, int]] = set()
    vertices: list[tuple[int, int, int]] = []
    links: list[list[tuple[int, int]]] = []
    edges: list[tuple[int, int, int]] = []

    def around(node: list[tuple[int, int]]) -> set[tuple[int, int]]:
        return {(x + dx, y + dy) for x, y in node for dx, dy in CELLS if (dx or dy) and (x + dx, y + dy) in on}

    def add(vertex: tuple[int, int, int], parent: int | None, length: int) -> int:
        vertices.append(vertex)
        links.append([])
        me = len(vertices) - 1
        if parent is not None:
            links[me].append((parent, length))
            links[parent].append((me, length))
            edges.append((parent, me, length))
        return me

    for start in starts:
        on.add(start)
        seen.add(start)
        root = add((-1, *start), None, 0)
        todo = [([*group, start], root, 0.0) for group in clusters(around([start]))]
        while todo:
            node, parent, length = todo.pop()
            groups = clusters(around(node) - set(node))
            found = [any(p in seen for p in g) for g in groups]
            here = _centre(node)
            if len(groups) == 1 and found[0]:
                add((1, *here), parent, int(length))
            seen.update(node)
            if len(groups) > 2:
                parent, length = add((0, *here), parent, int(length)), 0.0
            for g in groups:
                if not any(p in seen for p in g):
                    there = _centre(g)
                    todo.append((g, parent, length + float(np.hypot(here[0] - there[0], here[1] - there[1]))))
    ends = []
    for i, (kind, x, y) in enumerate(vertices):
        branch = 0.0
        if kind == 1:
            parent, n = links[i][0]
            branch = float(n)
            if vertices[parent][0] == -1 and len(links[parent]) == 2:
                branch += sum(m for other, m in links[parent] if other != i)
        ends.append((kind, x, y, branch))
    return ends, edges


def layer_endpoints(fg: np.ndarray, saliency: float, margin: int = 10) -> list[tuple[int, int, float, float, float]]:
    """x, y, saliency, distance over branch length, and branch length of a layer's skeleton ends away from the border."""
    one, imp1, dt = skeleton_field(fg, saliency, False)
    two, imp2, _ = skeleton_field(fg, saliency, True)
    mask, imp = one & two, np.minimum(imp1, imp2)
    ny, nx = fg.shape
    out = []
    for kind, x, y, branch in trace(mask, start_points(fg, mask, imp))[0]:
        if kind == 1 and not (x < margin or x > nx - margin or y < margin or y > ny - margin) and 0 <= x < nx and 0 <= y < ny:
            d = float(dt[y, x])
            out.append((x, y, float(imp[y, x]) / d if d else 0.0, d / branch if branch else 0.0, branch))
    return out


def endpoints(raster: DataFrame, saliency: float = 1.6, step: int = 1, margin: int = 10) -> DataFrame:
    """image_id, level, times, x, y, saliency, norm_dt, distance: skeleton ends of the levels 1, 1 + step, ... 255; times is the number of levels a row stands for."""
    if step < 1:
        raise ValueError("step must be 1 or more")
    wanted = np.arange(1, 256, int(step))

    def spread(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for r in pdf.itertuples():
            values = np.unique(np.asarray(r.data).astype(np.int64))
            first = values[np.minimum(np.searchsorted(values, wanted), len(values) - 1)]
            reps, times = np.unique(first[wanted <= values[-1]], return_counts=True)
            yield pd.DataFrame({"image_id": r.image_id, "nx": r.nx, "ny": r.ny, "data": [r.data] * len(reps), "level": reps.astype(np.int32), "times": times.astype(np.int32)})

    def levels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield from spread(pdf)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                a = np.asarray(r.data).reshape(r.ny, r.nx)
                rows += [(r.image_id, r.level, r.times, *e) for e in layer_endpoints(a >= r.level, saliency, margin)]
            yield pd.DataFrame(rows, columns=["image_id", "level", "times", "x", "y", "saliency", "norm_dt", "distance"])

    spread_out = pack(raster).mapInPandas(levels, "image_id string, nx int, ny int, data array<double>, level int, times int").repartition("image_id", "level")
    return spread_out.mapInPandas(run, "image_id string, level int, times int, x int, y int, saliency double, norm_dt double, distance double")


def endpoint_density(raster: DataFrame, found: DataFrame) -> DataFrame:
    """Dense raster of the number of endpoints at each pixel over all levels."""
    n = found.groupBy("image_id", "x", "y").agg(F.sum("times").cast("double").alias("n"))
    return raster.join(n, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("n", F.lit(0.0)).alias("v"))


def skeleton_corners(raster: DataFrame, saliency: float = 1.6, step: int = 1, nms: int = 8, blur: int = 5, margin: int = 10, islands: float | None = 0.05) -> DataFrame:
    """Corner detector: islands removed, endpoints of all levels counted, blurred, local maxima kept and thinned out, ranked by response."""
    from gridloom.operators.components import remove_islands
    from gridloom.operators.keypoints import top_n

    clean = remove_islands(raster, islands) if islands is not None else raster
    density = density_blur(endpoint_density(raster, endpoints(clean, saliency, step, margin)), blur)
    maxima = local_maxima(density, nms)
    dense = densify(raster.select("image_id", "x", "y").join(maxima.select("image_id", "x", "y", "v"), ["image_id", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))))
    return top_n(suppress(dense, nms).withColumnRenamed("v", "response"), None)
