"""Neighbourhood operators. Dense rasters use window frames (row frames need every cell: densify first), sparse ones offset joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["image_id", "x", "y"]
EIGHT = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def _offsets(offsets: Sequence[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))


def densify(df: DataFrame, fill: float = 0.0) -> DataFrame:
    """Adds the missing pixels of each image's rectangle."""
    box = df.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    grid = box.select("image_id", "my", F.explode(F.sequence(F.lit(0), F.col("mx"))).alias("x")).select("image_id", "x", F.explode(F.sequence(F.lit(0), F.col("my"))).alias("y"))
    return grid.join(df, KEY, "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def neighbours(df: DataFrame, points: DataFrame, only_positive: bool = True, offsets: Sequence[tuple[int, int]] = EIGHT) -> DataFrame:
    """(image_id, x, y, nx, ny) of each point's neighbours inside the raster, those of positive value or all."""
    cells = df.filter(F.col("v") > 0) if only_positive else df
    cells = cells.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    around = points.select(*KEY, _offsets(offsets).alias("o"))
    around = around.select(*KEY, (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    return around.join(cells, ["image_id", "nx", "ny"]).select(*KEY, "nx", "ny")


def neighbour_set(df: DataFrame, points: DataFrame) -> DataFrame:
    """The distinct positive neighbours of a set of points, itself left out (union, then set difference)."""
    found = neighbours(df, points).select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()
    return found.join(points.select(*KEY), KEY, "left_anti")


def adjacent(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """8-adjacent and not the same."""
    return (F.abs(x1 - x2) <= 1) & (F.abs(y1 - y2) <= 1) & ((x1 != x2) | (y1 != y2))


def _frame(df: DataFrame, value: Column, fn, low: int, high: int, along: str, across: str) -> Column:
    return fn(value).over(Window.partitionBy("image_id", across).orderBy(along).rowsBetween(low, high))


def box_filter(df: DataFrame, fn, width: int, height: int, value: str = "v", into: str = "v") -> DataFrame:
    """fn (F.max, F.min, F.sum) over width x height boxes of a dense raster, rows then columns; an even side reaches one further back."""
    wx, wy = (-(width // 2), (width - 1) // 2), (-(height // 2), (height - 1) // 2)
    out = df.withColumn(into, _frame(df, F.col(value), fn, *wx, "x", "y"))
    return out.withColumn(into, _frame(out, F.col(into), fn, *wy, "y", "x"))


def dilate(df: DataFrame, width: int, height: int | None = None) -> DataFrame:
    return box_filter(df, F.max, width, height or width)


def erode(df: DataFrame, width: int, height: int | None = None) -> DataFrame:
    return box_filter(df, F.min, width, height or width)


def dilate_cross(df: DataFrame) -> DataFrame:
    """Maximum over a pixel and its four neighbours."""
    row = F.max("v").over(Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1))
    col = F.max("v").over(Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1))
    return df.select(*KEY, F.greatest(row, col).alias("v"))


def full_dilate(df: DataFrame) -> DataFrame:
    """255 in the 3 x 3 surroundings of positive pixels, else the value."""
    near = box_filter(df.withColumn("near", F.when(F.col("v") > 0, 1).otherwise(0)), F.max, 3, 3, "near", "near")
    return near.select(*KEY, F.when(F.col("near") > 0, 255.0).otherwise(F.col("v")).alias("v"))


def full_erode(df: DataFrame) -> DataFrame:
    """0 wherever the 3 x 3 surroundings hold a 0."""
    return erode(df, 3)


def _shifted(df: DataFrame, dx: int, dy: int, value: str = "v") -> Column:
    """Value at (x + dx, y + dy) for one nonzero offset, null outside."""
    along, across, d = ("x", "y", dx) if dx else ("y", "x", dy)
    return F.lead(value, d).over(Window.partitionBy("image_id", across).orderBy(along)) if d > 0 else F.lag(value, -d).over(Window.partitionBy("image_id", across).orderBy(along))


def gradient_norm(df: DataFrame) -> DataFrame:
    """Squared norm of the central-difference gradient, over 4; beyond the low border the index mirrors to 1, beyond the high one to the pixel itself."""
    left = F.coalesce(_shifted(df, -1, 0), _shifted(df, 1, 0), F.col("v"))
    right = F.coalesce(_shifted(df, 1, 0), F.col("v"))
    up = F.coalesce(_shifted(df, 0, -1), _shifted(df, 0, 1), F.col("v"))
    down = F.coalesce(_shifted(df, 0, 1), F.col("v"))
    gx, gy = right - left, down - up
    return df.select(*KEY, (gx * gx / 4 + gy * gy / 4).alias("v"))


def forward_gradient(df: DataFrame, wrap: float | None = None) -> DataFrame:
    """Larger of the forward differences in x and y, as wrap-around distances if a length is given; 0 beyond the border."""
    from gridloom.functions.scalar import wrap_distance

    def d(c: Column) -> Column:
        c = F.coalesce(c - F.col("v"), F.lit(0.0))
        return wrap_distance(c, F.lit(wrap)) if wrap is not None else F.abs(c)

    return df.select(*KEY, F.greatest(d(_shifted(df, 1, 0)), d(_shifted(df, 0, 1))).alias("v"))


def two_pass_gradient(a: DataFrame, b: DataFrame, infinite: float = 1e7) -> DataFrame:
    """Smaller of two fields' forward gradients, 0 where it is infinite."""
    g = forward_gradient(a).join(forward_gradient(b).withColumnRenamed("v", "w"), KEY)
    m = F.least("v", "w")
    return g.select(*KEY, F.when(m >= infinite / 2, 0.0).otherwise(m).alias("v"))


def neighbour_code(df: DataFrame) -> DataFrame:
    """Eight bits of the positive neighbours, in the order of EIGHT (row by row)."""
    on = df.select(*KEY, F.when(F.col("v") > 0, 1).otherwise(0).alias("v"))
    rows = on.withColumn("w", F.coalesce(_shifted(on, -1, 0), F.lit(0))).withColumn("e", F.coalesce(_shifted(on, 1, 0), F.lit(0)))
    up, down = (lambda c: F.coalesce(F.lag(c).over(Window.partitionBy("image_id", "x").orderBy("y")), F.lit(0))), (
        lambda c: F.coalesce(F.lead(c).over(Window.partitionBy("image_id", "x").orderBy("y")), F.lit(0))
    )
    bits = [up("w"), up("v"), up("e"), F.col("w"), F.col("e"), down("w"), down("v"), down("e")]
    code = bits[0]
    for k, b in enumerate(bits[1:], 1):
        code = code + b * (1 << k)
    return rows.select(*KEY, F.col("v").alias("on"), code.alias("code"))


def _objects(code: int, centre: bool) -> int:
    """8-connected objects of the pixels set in a 3 x 3 window."""
    left = {EIGHT[k] for k in range(8) if code >> k & 1} | ({(0, 0)} if centre else set())
    n = 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            x, y = todo.pop()
            near = {(a, b) for a, b in left if abs(a - x) <= 1 and abs(b - y) <= 1}
            left -= near
            todo += near
    return n


def object_count(df: DataFrame) -> DataFrame:
    """Number of 8-connected objects among each pixel's positive neighbours (the pixel left out), by a 256-entry table."""
    table = F.array(*[F.lit(_objects(c, False)) for c in range(256)])
    return neighbour_code(df).select(*KEY, F.element_at(table, F.col("code") + 1).alias("objects"))


def skeleton_ends(df: DataFrame) -> DataFrame:
    """Positive pixels whose neighbours are one pixel, or two or three that lie next to each other on one side."""
    sides = [{(-1, -1), (0, -1), (1, -1)}, {(-1, 1), (0, 1), (1, 1)}, {(-1, -1), (-1, 0), (-1, 1)}, {(1, -1), (1, 0), (1, 1)}]
    ends = []
    for c in range(256):
        at = {EIGHT[k] for k in range(8) if c >> k & 1}
        if len(at) == 1 or (1 < len(at) <= 3 and _objects(c, False) == 1 and any(at <= s for s in sides)):
            ends.append(c)
    return neighbour_code(df).filter((F.col("on") == 1) & F.col("code").isin(ends)).select(*KEY)


def density_blur(df: DataFrame, width: int = 5) -> DataFrame:
    """Gaussian density with a zero border. For width 5 (weights 1 4 6 4 1) adds the exact integer sum ``weighted`` and v = weighted / 36."""
    if width == 1:
        return df.withColumn("weighted", F.col("v").cast("long"))
    weights = [1, 4, 6, 4, 1]  # fixed values: the binomial kernel of width 5

    def pass_(value: str, along: str, across: str) -> Column:
        w = Window.partitionBy("image_id", across).orderBy(along)
        terms = [F.coalesce(F.lag(value, 2).over(w), F.lit(0)), F.coalesce(F.lag(value, 1).over(w), F.lit(0)), F.col(value), F.coalesce(F.lead(value, 1).over(w), F.lit(0)), F.coalesce(F.lead(value, 2).over(w), F.lit(0))]
        total = terms[0] * weights[0]
        for t, k in zip(terms[1:], weights[1:], strict=True):
            total = total + t * k
        return total

    out = df.withColumn("n", F.col("v").cast("long")).withColumn("r", pass_("n", "x", "y"))
    out = out.withColumn("weighted", pass_("r", "y", "x"))
    return out.select(*KEY, (F.col("weighted") / 36.0).alias("v"), "weighted")


def local_maxima(df: DataFrame, width: int, height: int | None = None, value: str = "v") -> DataFrame:
    """Positive pixels that equal the maximum of their box."""
    top = box_filter(df.withColumn("top", F.col(value)), F.max, width, height or width, "top", "top")
    return top.filter((F.col("top") == F.col(value)) & (F.col(value) > 0)).drop("top")


def suppress(df: DataFrame, width: int, height: int | None = None, mode: str = "strict") -> DataFrame:
    """Two-stage non-maximum suppression of a dense raster.

    Local maxima are numbered column by column from 0; a positive pixel stays if its number (0 for others) is the
    largest in its box, so of equal maxima in a box the last stays. In mode ``reference`` that is all, which lets
    a non-maximum pass whose box holds no maximum numbered 1 or more; ``strict`` keeps local maxima only, numbered from 1."""
    h = height or width
    top = box_filter(df.withColumn("top", F.greatest("v", F.lit(0.0))), F.max, width, h, "top", "top")
    is_max = (F.col("top") == F.col("v")) & (F.col("v") > 0)
    peaks = top.filter(is_max).withColumn("no", F.row_number().over(Window.partitionBy("image_id").orderBy("x", "y")) - (1 if mode == "reference" else 0))
    marked = df.join(peaks.select(*KEY, "no"), KEY, "left").withColumn("peak", F.col("no").isNotNull()).withColumn("no", F.coalesce("no", F.lit(0)))
    best = box_filter(marked.withColumn("best", F.col("no")), F.max, width, h, "best", "best")
    stays = (F.col("v") > 0) & (F.col("no") == F.col("best"))
    return best.filter(stays if mode == "reference" else stays & F.col("peak")).select(*KEY, "v")


def harris_response(df: DataFrame, block: int = 6, k: float = 0.05) -> DataFrame:
    """Harris response det - k trace^2 of 3 x 3 Sobel gradients summed over block x block boxes (borders count as 0)."""
    wx, wy = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    at = lambda c, n, w: F.coalesce(F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w), F.lit(0.0))
    d = df.withColumn("sx", at("v", 1, wx) + 2 * F.col("v") + at("v", -1, wx)).withColumn("dx", at("v", -1, wx) - at("v", 1, wx))
    d = d.withColumn("gx", at("dx", 1, wy) + 2 * F.col("dx") + at("dx", -1, wy)).withColumn("gy", at("sx", -1, wy) - at("sx", 1, wy))
    for name, e in (("xx", F.col("gx") * F.col("gx")), ("yy", F.col("gy") * F.col("gy")), ("xy", F.col("gx") * F.col("gy"))):
        d = d.withColumn(name, e)
        d = box_filter(d, F.sum, block, block, name, name)
    trace = F.col("xx") + F.col("yy")
    return d.select(*KEY, (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - k * trace * trace).alias("v"))


# The circle of radius 3, clockwise from the top.
CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]


def _has_arc(mask: int, n: int = 9) -> bool:
    return any(all(mask >> ((s + i) % 16) & 1 for i in range(n)) for s in range(16))


def fast_corners(df: DataFrame, limit: float) -> DataFrame:
    """Segment test: pixels with nine or more consecutive circle pixels all brighter or all darker by over ``limit``; v is the largest limit at which that holds (0-based integer steps)."""
    ring = df.select(*KEY, F.col("v").alias("c"), F.posexplode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in CIRCLE])).alias("k", "o"))
    ring = ring.select(*KEY, "c", "k", (F.col("x") + F.col("o.dx")).alias("px"), (F.col("y") + F.col("o.dy")).alias("py"))
    cells = df.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").alias("w"))
    d = ring.join(cells, ["image_id", "px", "py"]).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("w") - F.col("c")).alias("d")))), lambda s: s["d"]).alias("d"))
    d = d.filter(F.size("d") == 16)
    arcs = F.array(*[F.array(*[F.get("d", F.lit((s + i) % 16)) for i in range(9)]) for s in range(16)])
    bright = F.array_max(F.transform(arcs, lambda a: F.array_min(a)))
    dark = F.array_max(F.transform(arcs, lambda a: -F.array_max(a)))
    return d.select(*KEY, F.greatest(bright, dark).alias("v")).filter(F.col("v") > limit)


def thin_double(df: DataFrame) -> DataFrame:
    """Removes skeleton pixels, row by row, that have two or more neighbours which stay one object without them; later pixels see earlier removals, so it is one kernel call per image."""
    import numpy as np
    import pandas as pd

    one_object = np.array([bin(c).count("1") >= 2 and _objects(c, False) < 2 for c in range(256)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["y"].max()) + 3, int(pdf["x"].max()) + 3), dtype=bool)
        a[pdf["y"] + 1, pdf["x"] + 1] = pdf["v"] > 0
        for y, x in zip(*np.nonzero(a), strict=True):
            code = sum(1 << k for k, (dx, dy) in enumerate(EIGHT) if a[y + dy, x + dx])
            a[y, x] = not one_object[code]
        return pdf.assign(v=np.where(a[pdf["y"] + 1, pdf["x"] + 1], pdf["v"], 0.0))

    return df.select(*KEY, "v").groupBy("image_id").applyInPandas(run, "image_id string, x int, y int, v double")


def threshold_gradient(df: DataFrame, level: float) -> DataFrame:
    """Pixels above a level as a binary skeleton, with the place of the largest value of each image (the first in rows)."""
    best = F.min_by(F.struct("x", "y"), F.struct(-F.col("v"), "y", "x"))
    top = df.filter(F.col("v") > level).groupBy("image_id").agg(best.alias("top"))
    out = df.join(top, "image_id", "left")
    return out.select(*KEY, (F.col("v") > level).alias("skeleton"), ((F.col("x") == F.col("top.x")) & (F.col("y") == F.col("top.y"))).alias("strongest"))
