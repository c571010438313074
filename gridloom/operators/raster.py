"""Pixel projections and aggregates on rasters (image_id, x, y, v).

Per-image extremes are aggregates joined back, not windows over an image: the aggregate is combined before its
shuffle and the join side has one row per image, so one large image is not gathered in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar

KEY = ["image_id", "x", "y"]
LEVELS = 256


def threshold(df: DataFrame, f: float) -> DataFrame:
    """0 from f on, else 255 (0 is foreground)."""
    return df.withColumn("v", F.when(F.col("v") >= f, 0.0).otherwise(255.0))


def threshold_inverse(df: DataFrame, f: float) -> DataFrame:
    """255 from f on, else 0."""
    return df.withColumn("v", F.when(F.col("v") >= f, 255.0).otherwise(0.0))


def layers(df: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Level sets: fg where v >= level, one row per pixel and level."""
    return df.select("image_id", F.explode(F.array(*[F.lit(int(i)) for i in levels])).alias("level"), "x", "y", "v").select(
        "image_id", "level", "x", "y", (F.col("v") >= F.col("level")).alias("fg")
    )


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Pixelwise ``add``, ``subtract``, ``divide`` (guarded), ``min`` of two rasters; pixels that b lacks keep a's value."""
    other = b.select(*KEY, F.col("v").alias("w"))
    v, w = F.col("v"), F.col("w")
    result = {"add": v + w, "subtract": v - w, "divide": scalar.guarded_divide(v, w), "min": F.least(v, w)}[op]
    return a.join(other, KEY, "left").select(*KEY, F.when(w.isNull(), v).otherwise(result).alias("v"))


def fill(df: DataFrame, f: float) -> DataFrame:
    return df.withColumn("v", F.lit(float(f)))


def scale(df: DataFrame, f: float) -> DataFrame:
    return df.withColumn("v", F.col("v") * f)


def statistics(df: DataFrame) -> DataFrame:
    """n, lowest, highest (below the infinite) and mean per image or volume; those of fewer than two pixels give zeros."""
    v, one = F.col("v"), F.count("*") < 2
    real = F.max(F.when(v < scalar.INFINITE / 2, v))
    return df.groupBy("image_id").agg(
        F.count("*").alias("n"),
        F.when(one, 0.0).otherwise(F.min(v)).alias("lowest"),
        F.when(one, 0.0).otherwise(real).alias("highest"),
        F.when(one, 0.0).otherwise(F.sum(v) / F.count("*")).alias("mean"),
    )


def normalise(df: DataFrame) -> DataFrame:
    """To 0..1 between lowest and highest; above the highest 1; the range is 1e-5 at least."""
    s = statistics(df).select("image_id", "lowest", "highest")
    span = F.greatest(F.col("highest") - F.col("lowest"), F.lit(1e-5))
    v = F.when(F.col("v") > F.col("highest"), 1.0).otherwise((F.col("v") - F.col("lowest")) / span)
    return df.join(s, "image_id").select(*KEY, v.alias("v"))


def stretch(df: DataFrame) -> DataFrame:
    """Min-max scaled to 0..255; constant images give 0."""
    s = df.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return df.join(s, "image_id").select(*KEY, v.alias("v"))


def log_scale(df: DataFrame) -> DataFrame:
    return df.withColumn("v", scalar.log_map(F.col("v")))


def colour(df: DataFrame) -> DataFrame:
    """A 0..1 raster on the rainbow map: r, g, b in 0..1."""
    r, g, b = scalar.rainbow(F.col("v"))
    return df.select(*KEY, r.alias("r"), g.alias("g"), b.alias("b"))


def size_of(df: DataFrame) -> DataFrame:
    """nx, ny per image."""
    return df.groupBy("image_id").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))


def look_up(df: DataFrame, at: DataFrame) -> DataFrame:
    """Values at integer places (image_id, x, y and more columns), folded back inside at the borders."""
    s = size_of(df)
    q = at.join(s, "image_id").withColumn("mx", scalar.mirrored(F.col("x"), F.col("nx"))).withColumn("my", scalar.mirrored(F.col("y"), F.col("ny")))
    cells = df.select("image_id", F.col("x").alias("mx"), F.col("y").alias("my"), "v")
    return q.join(cells, ["image_id", "mx", "my"], "left").drop("mx", "my", "nx", "ny")


def bilinear(df: DataFrame, at: DataFrame) -> DataFrame:
    """Bilinear samples at real places (image_id, px, py and more columns), with mirrored borders."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    keys = list(at.columns)
    q = at.select("*", corner).withColumn("x", (F.floor("px") + F.col("c.i")).cast("int")).withColumn("y", (F.floor("py") + F.col("c.j")).cast("int"))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    part = F.when(F.col("c.i") == 1, fx).otherwise(1 - fx) * F.when(F.col("c.j") == 1, fy).otherwise(1 - fy)
    return look_up(df, q).groupBy(*keys).agg(F.sum(part * F.col("v")).alias("v"))


def histogram(df: DataFrame) -> DataFrame:
    """Count of each of the 256 gray levels: image_id, level, n."""
    n = df.groupBy("image_id", F.col("v").cast("int").alias("level")).agg(F.count("*").alias("n"))
    grid = df.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    return grid.join(n, ["image_id", "level"], "left").select("image_id", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def upper_levels(hist: DataFrame) -> DataFrame:
    """Adds up (share of pixels at or above the level, less 1e-5) and relative (count over the largest count); 256 rows per image."""
    image = Window.partitionBy("image_id")
    above = image.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("up", F.sum("n").over(above) / F.sum("n").over(image) - 1e-5).withColumn("relative", F.col("n") / F.max("n").over(image))


def distinct_levels(df: DataFrame) -> DataFrame:
    """Sorted distinct gray levels as an array; at most 256 for gray images."""
    return df.groupBy("image_id").agg(F.array_sort(F.collect_set(F.col("v").cast("int"))).alias("levels"))


def select_layers(upper: DataFrame, drop: float, gap: int) -> DataFrame:
    """Greedy choice of levels: the next one at which the mass has fallen by more than ``drop``, ``gap`` levels on at least."""
    arrays = upper.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "up"))), lambda s: s["up"]).alias("up"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("chosen"))

    def step(s: Column, i: Column) -> Column:
        take = (i - s["at"] >= gap) & (F.get("up", s["at"]) - F.get("up", i) > drop)
        return F.struct(F.when(take, i).otherwise(s["at"]).alias("at"), F.when(take, F.concat(s["chosen"], F.array(i))).otherwise(s["chosen"]).alias("chosen"))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS - 1)), start, step, lambda s: s["chosen"])
    return arrays.select("image_id", F.explode(chosen).alias("level"))


def snap_levels(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Each pixel moves to the nearest selected level of its image (image_id, level); of two equally near the lower."""
    levels = selected.groupBy("image_id").agg(F.array_sort(F.collect_set("level")).alias("levels"))  # 256 at most
    near = F.array_min(F.transform("levels", lambda k: F.struct(F.abs(k - F.col("v").cast("int")).alias("d"), k.alias("k"))))
    return df.join(levels, "image_id", "left").select(*KEY, F.coalesce(near["k"].cast("double"), F.col("v")).alias("v"))


def pack(df: DataFrame) -> DataFrame:
    """One row per image or volume (rows with z): nx, ny, nz and the values row by row, slice by slice."""
    axes = [c for c in ("z", "y", "x") if c in df.columns]
    nz = F.max("z") + 1 if "z" in axes else F.lit(1)
    values = F.transform(F.array_sort(F.collect_list(F.struct(*axes, "v"))), lambda s: s["v"])
    return df.groupBy("image_id").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"), nz.cast("int").alias("nz"), values.alias("data"))


def unpack(df: DataFrame) -> DataFrame:
    rows = df.select("image_id", "nx", F.posexplode("data").alias("i", "v"))
    return rows.select("image_id", (F.col("i") % F.col("nx")).alias("x"), F.expr("cast(i div nx as int)").alias("y"), "v")


def slice_volume(df: DataFrame, axis: str, at: int) -> DataFrame:
    """The 2-D slice of a volume (image_id, x, y, z, v) at a place on an axis."""
    u, w = [c for c in ("x", "y", "z") if c != axis]
    return df.filter(F.col(axis) == at).select("image_id", F.col(u).alias("x"), F.col(w).alias("y"), "v")


def insert_slice(df: DataFrame, part: DataFrame, axis: str, at: int) -> DataFrame:
    """The volume with the slice at a place replaced by a raster."""
    u, w = [c for c in ("x", "y", "z") if c != axis]
    new = part.select("image_id", F.col("x").alias(u), F.col("y").alias(w), F.lit(at).alias(axis), "v")
    return df.filter(F.col(axis) != at).unionByName(new)


def subsample(df: DataFrame, stride: int) -> DataFrame:
    axes = [c for c in ("x", "y", "z") if c in df.columns]
    for c in axes:
        df = df.filter(F.col(c) % stride == 0).withColumn(c, F.expr(f"cast({c} div {stride} as int)"))
    return df


def bundle(points: DataFrame, nearest: DataFrame, alpha: float, epsilon: float) -> DataFrame:
    """Skeleton points (image_id, x, y) move toward the previous layer's nearest point (nearest: image_id, x, y, sx, sy) by alpha of the way, epsilon at most."""
    j = points.join(nearest, KEY, "left")
    tx, ty = F.expr(f"cast({alpha}D * (sx - x) as int)"), F.expr(f"cast({alpha}D * (sy - y) as int)")
    n = F.sqrt(tx * tx + ty * ty)
    step = F.least(n, F.lit(float(epsilon)))
    move = n > 0
    return j.select(
        *KEY,
        F.when(move, F.round(F.col("x") + tx / n * step)).otherwise(F.col("x")).cast("int").alias("nx"),
        F.when(move, F.round(F.col("y") + ty / n * step)).otherwise(F.col("y")).cast("int").alias("ny"),
    )


def overlap_prune(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skeletons as (image_id, x, y, v: radius). Points of the previous layer go where the current radius is as large; also the percentage per image."""
    both = previous.join(current.select(*KEY, F.col("v").alias("r")), KEY)
    gone = both.filter(F.col("r") >= F.col("v"))
    share = both.groupBy("image_id").agg((F.count_if(F.col("r") >= F.col("v")) * 100.0 / F.count("*")).alias("percent"))
    return previous.join(gone.select(*KEY), KEY, "left_anti"), share


def difference_statistics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest, smallest and mean absolute difference of two rasters per image."""
    d = F.abs(F.col("v") - F.col("w"))
    j = a.join(b.select(*KEY, F.col("v").alias("w")), KEY)
    return j.groupBy("image_id").agg(F.max(d).alias("largest"), F.min(d).alias("smallest"), (F.sum(d) / F.count("*")).alias("mean"))


def centroids(df: DataFrame, weight: str = "v") -> DataFrame:
    """Plain and weighted centroids of the pixels with a positive weight."""
    w = F.col(weight)
    p = df.filter(w > 0)
    return p.groupBy("image_id").agg(
        (F.sum("x") / F.count("*")).alias("cx"), (F.sum("y") / F.count("*")).alias("cy"), (F.sum(F.col("x") * w) / F.sum(w)).alias("wx"), (F.sum(F.col("y") * w) / F.sum(w)).alias("wy")
    )
