"""Queries of pixel projections, aggregates and stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import adapters as A
from gridloom.operators import raster as R
from gridloom.operators import stencil as S
from gridloom.plans.registry import register

PX = "image_id, x, y"

register("prj01_threshold", lambda s, d: R.threshold(A.part_raster(s, d), 5), f" SELECT {PX}, CASE WHEN v >= 5 THEN 0.0 ELSE 255.0 END::DOUBLE AS v FROM part_raster", "part_raster")
register("prj02_threshold_inverse", lambda s, d: R.threshold_inverse(A.part_raster(s, d), 5), f" SELECT {PX}, CASE WHEN v >= 5 THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM part_raster", "part_raster")
register(
    "layers_of_levels",
    lambda s, d: R.layers(A.event_raster(s, d), [1, 2, 5, 9]).groupBy("image_id", "level").agg(F.count_if("fg").alias("n_fg")),
    " SELECT image_id, l AS level, count(*) FILTER (v >= l) AS n_fg FROM event_raster, (VALUES (1), (2), (5), (9)) t(l) GROUP BY ALL",
    "event_raster",
)
register(
    "prj05_combine",
    lambda s, d: R.combine(R.scale(A.part_raster(s, d), 3.0), A.part_raster(s, d).filter("x < 30"), "add"),
    f" SELECT {PX}, v * 3 + CASE WHEN x < 30 THEN v ELSE 0 END AS v FROM part_raster",
    "part_raster",
)
register(
    "prj05_subtract",
    lambda s, d: R.combine(R.scale(A.part_raster(s, d), 3.0), A.part_raster(s, d), "subtract"),
    f" SELECT {PX}, v * 3 - v AS v FROM part_raster",
    "part_raster",
)
register(
    "prj06_divide",
    lambda s, d: R.combine(R.scale(A.part_raster(s, d), 6.0), A.part_raster(s, d), "divide"),
    f" SELECT {PX}, CASE WHEN v > 0 THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM part_raster",
    "part_raster",
)
register("prj07_fill_scale", lambda s, d: R.scale(R.fill(A.part_raster(s, d), 2.0), 1.5), f" SELECT {PX}, 3.0::DOUBLE AS v FROM part_raster", "part_raster")
STATS = "image_id, count(*) AS n, min(v) AS lowest, max(v) AS highest, sum(v) / count(*) AS mean"
register("agg01_statistics", lambda s, d: R.statistics(A.part_raster(s, d)), f" SELECT {STATS} FROM part_raster GROUP BY image_id", "part_raster")
register("agg24_volume_statistics", lambda s, d: R.statistics(A.event_volume(s, d)), f" SELECT {STATS} FROM event_volume GROUP BY image_id", "event_raster event_volume")
register(
    "prj08_normalise",
    lambda s, d: R.normalise(A.part_raster(s, d)),
    f" SELECT {PX}, (v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-5::DOUBLE) AS v FROM part_raster WINDOW w AS (PARTITION BY image_id)",
    "part_raster",
)
register(
    "prj09_stretch",
    lambda s, d: R.stretch(A.embed_raster(s, d)).withColumn("v", F.round("v", 6)),
    f" SELECT {PX}, round((v - min(v) OVER w) * 255.0::DOUBLE / (max(v) OVER w - min(v) OVER w), 6) AS v FROM embed_raster WINDOW w AS (PARTITION BY image_id)",
    "embed_raster",
)
register(
    "prj10_log_scale",
    lambda s, d: R.log_scale(A.part_raster(s, d)).withColumn("v", F.round("v", 9)),
    f" SELECT {PX}, round(CASE WHEN v >= 1 THEN ln(v) ELSE 0 END, 9) AS v FROM part_raster",
    "part_raster",
)
register(
    "prj11_rainbow",
    lambda s, d: R.colour(R.normalise(A.part_raster(s, d))).select(*S.KEY, *[F.round(c, 9).alias(c) for c in "rgb"]),
    f""", n AS (SELECT {PX}, 4.4::DOUBLE * ((v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-5::DOUBLE)) + 0.8::DOUBLE AS t
       FROM part_raster WINDOW w AS (PARTITION BY image_id))
    SELECT {PX}, round(greatest(0, (3 - abs(t - 4) - abs(t - 5)) / 2), 9) AS r, round(greatest(0, (4 - abs(t - 2) - abs(t - 4)) / 2), 9) AS g,
           round(greatest(0, (3 - abs(t - 1) - abs(t - 2)) / 2), 9) AS b FROM n""",
    "part_raster",
)


def _shifted_places(s, d):
    return A.event_raster(s, d).select("image_id", (F.col("x") - 3).alias("x"), (F.col("y") + 5).alias("y"))


register(
    "prj13_mirrored_lookup",
    lambda s, d: R.look_up(A.event_raster(s, d), _shifted_places(s, d)),
    """, q AS (SELECT image_id, x - 3 AS x, y + 5 AS y FROM event_raster)
    SELECT q.image_id, q.x, q.y, e.v FROM q JOIN event_raster e ON e.image_id = q.image_id
      AND e.x = CASE WHEN q.x < 0 THEN -q.x WHEN q.x >= 24 THEN 48 - q.x - 1 ELSE q.x END
      AND e.y = CASE WHEN q.y < 0 THEN -q.y WHEN q.y >= 30 THEN 60 - q.y - 1 ELSE q.y END""",
    "event_raster",
)
register(
    "prj12_bilinear",
    lambda s, d: R.bilinear(A.event_raster(s, d), A.event_raster(s, d).filter("x < 23 and y < 29").select("image_id", (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"))),
    """ SELECT a.image_id, a.x + 0.25::DOUBLE AS px, a.y + 0.5::DOUBLE AS py, 0.375 * a.v + 0.125 * b.v + 0.375 * c.v + 0.125 * e.v AS v
    FROM event_raster a JOIN event_raster b ON b.image_id = a.image_id AND b.x = a.x + 1 AND b.y = a.y
    JOIN event_raster c ON c.image_id = a.image_id AND c.x = a.x AND c.y = a.y + 1
    JOIN event_raster e ON e.image_id = a.image_id AND e.x = a.x + 1 AND e.y = a.y + 1""",
    "event_raster",
)
SELECTED = "(VALUES (2), (6), (13)) t(k)"


def _levels(s, d):
    images = A.part_raster(s, d).select("image_id").distinct()
    return images.select("image_id", F.explode(F.array(F.lit(2), F.lit(6), F.lit(13))).alias("level"))


register(
    "prj14_snap_levels",
    lambda s, d: R.snap_levels(A.part_raster(s, d), _levels(s, d)),
    f" SELECT {PX}, CAST((SELECT min(k) FROM {SELECTED} WHERE abs(k - v) = (SELECT min(abs(k - v)) FROM {SELECTED})) AS DOUBLE) AS v FROM part_raster",
    "part_raster",
)
register(
    "prj15_bundle",
    lambda s, d: R.bundle(A.event_raster(s, d).filter("v > 2").select(*S.KEY), A.event_raster(s, d).select(*S.KEY, (F.expr("x div 5") * 5).alias("sx"), (F.expr("y div 5") * 5).alias("sy")), 0.9, 2.0),
    """, p AS (SELECT image_id, x, y, CAST(trunc(0.9::DOUBLE * ((x // 5) * 5 - x)) AS INT) AS tx, CAST(trunc(0.9::DOUBLE * ((y // 5) * 5 - y)) AS INT) AS ty FROM event_raster WHERE v > 2),
    n AS (SELECT *, sqrt(CAST(tx * tx + ty * ty AS DOUBLE)) AS n FROM p)
    SELECT image_id, x, y, CAST(CASE WHEN n > 0 THEN round(x + tx / n * least(n, 2.0::DOUBLE)) ELSE x END AS INT) AS nx,
           CAST(CASE WHEN n > 0 THEN round(y + ty / n * least(n, 2.0::DOUBLE)) ELSE y END AS INT) AS ny FROM n""",
    "event_raster",
)


def _prune(s, d, part):
    r = A.event_raster(s, d)
    current = r.filter("v > 1").withColumn("v", F.col("x") % 5 + F.lit(0.0))
    previous = r.filter("v > 0").withColumn("v", F.col("y") % 4 + F.lit(0.0))
    return R.overlap_prune(current, previous)[part]


PRUNE = """, c AS (SELECT image_id, x, y, CAST(x % 5 AS DOUBLE) AS r FROM event_raster WHERE v > 1),
    p AS (SELECT image_id, x, y, CAST(y % 4 AS DOUBLE) AS v FROM event_raster WHERE v > 0)"""
register(
    "prj16_overlap_prune",
    lambda s, d: _prune(s, d, 0),
    PRUNE + " SELECT p.* FROM p LEFT JOIN c USING (image_id, x, y) WHERE c.r IS NULL OR c.r < p.v",
    "event_raster",
)
register(
    "prj16_overlap_share",
    lambda s, d: _prune(s, d, 1),
    PRUNE + " SELECT image_id, count(*) FILTER (c.r >= p.v) * 100.0::DOUBLE / count(*) AS percent FROM p JOIN c USING (image_id, x, y) GROUP BY image_id",
    "event_raster",
)
register(
    "prj18_volume_slice",
    lambda s, d: R.slice_volume(A.event_raster(s, d).withColumn("z", F.col("x") % 7), "z", 3),
    " SELECT image_id, x, y, v FROM event_raster WHERE x % 7 = 3",
    "event_raster",
)
register(
    "prj18_insert_slice",
    lambda s, d: R.insert_slice(A.event_raster(s, d).withColumn("z", F.lit(0)), R.scale(A.event_raster(s, d), 2.0), "z", 1).groupBy("image_id", "z").agg(F.sum("v").alias("v")),
    " SELECT image_id, z, sum(v * (z + 1)) AS v FROM event_raster, (VALUES (0), (1)) t(z) GROUP BY ALL",
    "event_raster",
)
register("prj18_subsample", lambda s, d: R.subsample(A.part_raster(s, d), 3), " SELECT image_id, x // 3 AS x, y // 3 AS y, v FROM part_raster WHERE x % 3 = 0 AND y % 3 = 0", "part_raster")
register(
    "agg02_histogram",
    lambda s, d: R.histogram(A.part_raster(s, d)),
    " SELECT i.image_id, CAST(l AS INT) AS level, count(p.v) AS n FROM (SELECT DISTINCT image_id FROM part_raster) i, range(256) t(l) LEFT JOIN part_raster p ON p.image_id = i.image_id AND p.v = l GROUP BY ALL",
    "part_raster",
)
UPPER = """, h AS (SELECT i.image_id, CAST(l AS INT) AS level, count(p.v) AS n FROM (SELECT DISTINCT image_id FROM embed_raster) i, range(256) t(l)
      LEFT JOIN embed_raster p ON p.image_id = i.image_id AND p.v = l GROUP BY ALL),
    u AS (SELECT image_id, level, n, sum(n) OVER (PARTITION BY image_id ORDER BY level DESC) / sum(n) OVER (PARTITION BY image_id) - 1e-5::DOUBLE AS up,
                 n / max(n) OVER (PARTITION BY image_id) AS relative FROM h)"""
register(
    "agg03_upper_levels",
    lambda s, d: R.upper_levels(R.histogram(A.embed_raster(s, d))),
    UPPER + " SELECT image_id, level, n, CAST(up AS DOUBLE) AS up, CAST(relative AS DOUBLE) AS relative FROM u",
    "embed_raster",
)
register(
    "agg05_distinct_levels",
    lambda s, d: R.distinct_levels(A.part_raster(s, d)).select("image_id", F.explode("levels").alias("level")),
    " SELECT DISTINCT image_id, CAST(v AS INT) AS level FROM part_raster",
    "part_raster",
)
register(
    "win05_select_layers",
    lambda s, d: R.select_layers(R.upper_levels(R.histogram(A.embed_raster(s, d))), 0.15, 5),
    UPPER
    + """, RECURSIVE r AS (
      SELECT image_id, 0 AS level FROM u WHERE level = 0
      UNION ALL
      SELECT * FROM (SELECT r.image_id, (SELECT min(b.level) FROM u a, u b WHERE a.image_id = r.image_id AND b.image_id = r.image_id AND a.level = r.level AND b.level >= r.level + 5 AND a.up - b.up > 0.15::DOUBLE) AS level FROM r) WHERE level IS NOT NULL)
    SELECT image_id, level FROM r WHERE level > 0""",
    "embed_raster",
)
register(
    "layout_pack_unpack",
    lambda s, d: R.unpack(R.pack(A.embed_raster(s, d))),
    " SELECT * FROM embed_raster",
    "embed_raster",
)
register(
    "agg17_centroids",
    lambda s, d: R.centroids(A.part_raster(s, d)),
    " SELECT image_id, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy, sum(x * v) / sum(v) AS wx, sum(y * v) / sum(v) AS wy FROM part_raster WHERE v > 0 GROUP BY image_id",
    "part_raster",
)
register(
    "agg18_difference",
    lambda s, d: R.difference_statistics(A.part_raster(s, d), R.scale(A.part_raster(s, d), 2.0)),
    " SELECT image_id, max(v) AS largest, min(v) AS smallest, sum(v) / count(*) AS mean FROM part_raster GROUP BY image_id",
    "part_raster",
)

# stencils
OFF8 = "(SELECT a - 1 AS dx, b - 1 AS dy FROM range(3) t(a), range(3) u(b) WHERE NOT (a = 1 AND b = 1)) o"
register(
    "nbr01_neighbours",
    lambda s, d: S.neighbours(A.event_raster(s, d), A.event_raster(s, d).filter("v > 3")),
    f" SELECT p.image_id, p.x, p.y, q.x AS nx, q.y AS ny FROM event_raster p, {OFF8}, event_raster q WHERE p.v > 3 AND q.v > 0 AND q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy",
    "event_raster",
)
register(
    "nbr01_neighbour_set",
    lambda s, d: S.neighbour_set(A.event_raster(s, d), A.event_raster(s, d).filter("v > 3")),
    f""" SELECT DISTINCT q.image_id, q.x, q.y FROM event_raster p, {OFF8}, event_raster q
    WHERE p.v > 3 AND q.v > 0 AND q.v <= 3 AND q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy""",
    "event_raster",
)
register(
    "nbr02_all_neighbours",
    lambda s, d: S.neighbours(A.event_raster(s, d), A.event_raster(s, d), only_positive=False).groupBy("image_id").agg(F.count("*").alias("n")),
    f" SELECT p.image_id, count(*) AS n FROM event_raster p, {OFF8}, event_raster q WHERE q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY p.image_id",
    "event_raster",
)
BOX = "SELECT a.image_id, a.x, a.y, {f}(b.v) AS v FROM {t} a JOIN {t} b ON b.image_id = a.image_id AND b.x BETWEEN a.x - {l} AND a.x + {h} AND b.y BETWEEN a.y - {l} AND a.y + {h} GROUP BY ALL"
register("nbr03_dilate_5", lambda s, d: S.dilate(A.part_raster(s, d), 5), " " + BOX.format(f="max", t="part_raster", l=2, h=2), "part_raster")
register("nbr03_dilate_8", lambda s, d: S.dilate(A.part_raster(s, d), 8), " " + BOX.format(f="max", t="part_raster", l=4, h=3), "part_raster")
register("nbr05_erode_3", lambda s, d: S.erode(A.part_raster(s, d), 3), " " + BOX.format(f="min", t="part_raster", l=1, h=1), "part_raster")
register(
    "nbr04_full_dilate",
    lambda s, d: S.full_dilate(A.event_raster(s, d)),
    " SELECT a.image_id, a.x, a.y, CASE WHEN max(b.v) > 0 THEN 255.0::DOUBLE ELSE a.v END AS v FROM event_raster a JOIN event_raster b ON b.image_id = a.image_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY a.image_id, a.x, a.y, a.v",
    "event_raster",
)
register(
    "snk09_cross_dilate",
    lambda s, d: S.dilate_cross(A.event_raster(s, d)),
    " SELECT a.image_id, a.x, a.y, max(b.v) AS v FROM event_raster a JOIN event_raster b ON b.image_id = a.image_id AND abs(b.x - a.x) + abs(b.y - a.y) <= 1 GROUP BY ALL",
    "event_raster",
)
CODE = """, c AS (SELECT a.image_id, a.x, a.y, CASE WHEN a.v > 0 THEN 1 ELSE 0 END AS "on", CAST(sum(CASE WHEN b.v > 0 THEN
       CASE (b.y - a.y + 1) * 3 + (b.x - a.x + 1) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 5 THEN 16 WHEN 6 THEN 32 WHEN 7 THEN 64 WHEN 8 THEN 128 ELSE 0 END
       ELSE 0 END) AS INT) AS code
     FROM event_raster a JOIN event_raster b ON b.image_id = a.image_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY a.image_id, a.x, a.y, a.v)"""
register("nbr06_neighbour_code", lambda s, d: S.neighbour_code(A.event_raster(s, d)), CODE + " SELECT * FROM c", "event_raster")
register(
    "nbr06_object_count",
    lambda s, d: S.object_count(A.event_raster(s, d)).groupBy("image_id", "objects").agg(F.count("*").alias("n")),
    # objects of the ring = runs of set neighbours around the pixel, where a corner between two set sides does not split them
    CODE
    + """, b AS (SELECT image_id, x, y, [code & 1, code >> 1 & 1, code >> 2 & 1, code >> 4 & 1, code >> 7 & 1, code >> 6 & 1, code >> 5 & 1, code >> 3 & 1] AS r FROM c),
    f AS (SELECT image_id, [CASE WHEN r[1] > 0 THEN 1 ELSE 0 END, CASE WHEN r[2] > 0 THEN 1 ELSE 0 END, CASE WHEN r[3] > 0 THEN 1 ELSE 0 END, CASE WHEN r[4] > 0 THEN 1 ELSE 0 END,
                    CASE WHEN r[5] > 0 THEN 1 ELSE 0 END, CASE WHEN r[6] > 0 THEN 1 ELSE 0 END, CASE WHEN r[7] > 0 THEN 1 ELSE 0 END, CASE WHEN r[8] > 0 THEN 1 ELSE 0 END] AS r FROM b),
    g AS (SELECT image_id, [r[1] | (r[8] & r[2]), r[2], r[3] | (r[2] & r[4]), r[4], r[5] | (r[4] & r[6]), r[6], r[7] | (r[6] & r[8]), r[8]] AS r FROM f),
    k AS (SELECT image_id, list_sum(r) AS s, (SELECT count(*) FROM range(8) t(i) WHERE r[i + 1] = 1 AND r[(i + 7) % 8 + 1] = 0) AS starts FROM g)
    SELECT image_id, CAST(CASE WHEN s = 8 THEN 1 ELSE starts END AS INT) AS objects, count(*) AS n FROM k GROUP BY ALL""",
    "event_raster",
)
# a pixel's neighbours are one, or two or three in a row along one side
register(
    "nbr14_skeleton_ends",
    lambda s, d: S.skeleton_ends(R.threshold_inverse(A.event_raster(s, d), 4)),
    ", t AS (SELECT image_id, x, y, CASE WHEN v >= 4 THEN 255 ELSE 0 END AS v FROM event_raster)"
    + CODE.replace("event_raster", "t")
    + """ SELECT image_id, x, y FROM c WHERE "on" = 1 AND (code IN (1, 2, 4, 8, 16, 32, 64, 128)
        OR code IN (1 + 2, 2 + 4, 1 + 2 + 4) OR code IN (32 + 64, 64 + 128, 32 + 64 + 128) OR code IN (1 + 8, 8 + 32, 1 + 8 + 32) OR code IN (4 + 16, 16 + 128, 4 + 16 + 128))""",
    "event_raster",
)
BLUR = """, b AS (SELECT a.image_id, a.x, a.y, CAST(sum(b.v * [1, 4, 6, 4, 1][b.x - a.x + 3] * [1, 4, 6, 4, 1][b.y - a.y + 3]) AS BIGINT) AS weighted
     FROM part_raster a JOIN part_raster b ON b.image_id = a.image_id AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2 GROUP BY a.image_id, a.x, a.y)"""
register("nbr08_density_blur", lambda s, d: S.density_blur(A.part_raster(s, d)), BLUR + " SELECT image_id, x, y, weighted / 36.0::DOUBLE AS v, weighted FROM b", "part_raster")
MAXIMA = BLUR + """, m AS (SELECT a.image_id, a.x, a.y, a.weighted FROM b a JOIN b c ON c.image_id = a.image_id AND c.x BETWEEN a.x - 4 AND a.x + 3 AND c.y BETWEEN a.y - 4 AND a.y + 3
     GROUP BY a.image_id, a.x, a.y, a.weighted HAVING a.weighted > 0 AND a.weighted = max(c.weighted))"""


def maxima(s, d):
    return S.local_maxima(S.density_blur(A.part_raster(s, d)), 8, value="weighted")


register("nbr09_local_maxima", lambda s, d: maxima(s, d).select(*S.KEY, "weighted"), MAXIMA + " SELECT * FROM m", "part_raster")


def corners(s, d, n=20):
    """Flagship: density blur, local maxima, the n strongest of each image."""
    from gridloom.operators.keypoints import top_n

    return top_n(maxima(s, d).withColumn("response", F.col("weighted").cast("double")), n).select("image_id", "rank", "x", "y", "weighted")


register(
    "m0_top_corners",
    corners,
    MAXIMA
    + " SELECT image_id, rank, x, y, weighted FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY weighted DESC, x, y) AS INT) AS rank FROM m) WHERE rank <= 20",
    "part_raster",
)
NMS = """, t AS (SELECT a.image_id, a.x, a.y, a.v, max(b.v) AS top FROM part_raster a JOIN part_raster b ON b.image_id = a.image_id AND b.x BETWEEN a.x - 4 AND a.x + 3 AND b.y BETWEEN a.y - 4 AND a.y + 3
      GROUP BY a.image_id, a.x, a.y, a.v),
    p AS (SELECT image_id, x, y, row_number() OVER (PARTITION BY image_id ORDER BY x, y) - {first} AS no FROM t WHERE v > 0 AND v = top),
    q AS (SELECT t.image_id, t.x, t.y, t.v, p.no IS NOT NULL AS peak, coalesce(p.no, 0) AS no FROM t LEFT JOIN p USING (image_id, x, y)),
    r AS (SELECT a.image_id, a.x, a.y, a.v, a.no, a.peak FROM q a JOIN q b ON b.image_id = a.image_id AND b.x BETWEEN a.x - 4 AND a.x + 3 AND b.y BETWEEN a.y - 4 AND a.y + 3
      GROUP BY a.image_id, a.x, a.y, a.v, a.no, a.peak HAVING a.no = max(b.no) AND a.v > 0)
    SELECT image_id, x, y, v FROM r"""
register("nbr10_nms_reference", lambda s, d: S.suppress(A.part_raster(s, d), 8, mode="reference"), NMS.format(first=1), "part_raster")
register("nbr10_nms_strict", lambda s, d: S.suppress(A.part_raster(s, d), 8), NMS.format(first=0) + " WHERE peak", "part_raster")
register(
    "nbr11_gradient_norm",
    lambda s, d: S.gradient_norm(A.part_raster(s, d)),
    """ SELECT a.image_id, a.x, a.y, (r.v - l.v) * (r.v - l.v) / 4 + (dn.v - u.v) * (dn.v - u.v) / 4 AS v
    FROM part_raster a JOIN part_raster l ON l.image_id = a.image_id AND l.y = a.y AND l.x = abs(a.x - 1)
    JOIN part_raster r ON r.image_id = a.image_id AND r.y = a.y AND r.x = least(a.x + 1, 49)
    JOIN part_raster u ON u.image_id = a.image_id AND u.x = a.x AND u.y = abs(a.y - 1)
    JOIN part_raster dn ON dn.image_id = a.image_id AND dn.x = a.x AND dn.y = least(a.y + 1, 49)""",
    "part_raster",
)
FORWARD = """, g AS (SELECT image_id, x, y, v, coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - v, 0) AS dx,
      coalesce(lead(v) OVER (PARTITION BY image_id, x ORDER BY y) - v, 0) AS dy FROM part_raster)"""
register(
    "nbr12_forward_gradient",
    lambda s, d: S.forward_gradient(A.part_raster(s, d), 10.0),
    FORWARD + " SELECT image_id, x, y, greatest(least(abs(dx), abs(10 - abs(dx))), least(abs(dy), abs(10 - abs(dy))))::DOUBLE AS v FROM g",
    "part_raster",
)
register(
    "nbr13_two_pass_gradient",
    lambda s, d: S.two_pass_gradient(A.part_raster(s, d), R.scale(A.part_raster(s, d), 0.5)),
    FORWARD + " SELECT image_id, x, y, greatest(abs(dx), abs(dy)) / 2 AS v FROM g",
    "part_raster",
)
HARRIS = """, k(i, s, d) AS (VALUES (-1, 1, -1), (0, 2, 0), (1, 1, 1)),
    g AS (SELECT a.image_id, a.x, a.y, sum(b.v * kx.d * ky.s) AS gx, sum(b.v * kx.s * ky.d) AS gy FROM part_raster a, k kx, k ky, part_raster b
      WHERE b.image_id = a.image_id AND b.x = a.x + kx.i AND b.y = a.y + ky.i GROUP BY a.image_id, a.x, a.y),
    h AS (SELECT a.image_id, a.x, a.y, sum(b.gx * b.gx) AS xx, sum(b.gy * b.gy) AS yy, sum(b.gx * b.gy) AS xy FROM g a JOIN g b
      ON b.image_id = a.image_id AND b.x BETWEEN a.x - 3 AND a.x + 2 AND b.y BETWEEN a.y - 3 AND a.y + 2 GROUP BY a.image_id, a.x, a.y)
    SELECT image_id, x, y, xx * yy - xy * xy - 0.05::DOUBLE * (xx + yy) * (xx + yy) AS v FROM h"""
register("nbr15_harris", lambda s, d: S.harris_response(A.part_raster(s, d)), HARRIS, "part_raster")
register(
    "nbr16_fast",
    lambda s, d: S.fast_corners(A.embed_raster(s, d), 6),
    """, c AS (SELECT unnest(range(16)) AS k, unnest([0, 1, 2, 3, 3, 3, 2, 1, 0, -1, -2, -3, -3, -3, -2, -1]) AS dx, unnest([-3, -3, -2, -1, 0, 1, 2, 3, 3, 3, 2, 1, 0, -1, -2, -3]) AS dy),
    r AS (SELECT a.image_id, a.x, a.y, c.k, b.v - a.v AS d FROM embed_raster a, c, embed_raster b WHERE b.image_id = a.image_id AND b.x = a.x + c.dx AND b.y = a.y + c.dy),
    w AS (SELECT image_id, x, y, k FROM r),
    arc AS (SELECT r.image_id, r.x, r.y, s.k AS s, min(r.d) AS lo, max(r.d) AS hi, count(*) AS n FROM r, (SELECT unnest(range(16)) AS k) s WHERE (r.k - s.k + 16) % 16 < 9 GROUP BY ALL),
    m AS (SELECT image_id, x, y, greatest(max(lo), max(-hi)) AS v FROM arc GROUP BY image_id, x, y HAVING min(n) = 9)
    SELECT image_id, x, y, v FROM m WHERE v > 6""",
    "embed_raster",
)
