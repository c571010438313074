"""Queries of keypoint ranking, matching and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom import adapters as A
from gridloom.functions import scalar
from gridloom.operators import keypoints as K
from gridloom.operators import match as M
from gridloom.plans.registry import register

BY = ["scene"]
H = [1.02, 0.01, -3, -0.015, 0.99, 4, 0.00001, 0.00002, 1]


def ranked(s, d, image):
    w = Window.partitionBy("scene").orderBy(F.desc("response"), "x", "y")
    return A.keypoints(s, d).filter(F.col("image_id") == image).withColumn("i", F.row_number().over(w) - 1)


def first(s, d):
    return ranked(s, d, "0")


def second(s, d):
    return ranked(s, d, "1").withColumnRenamed("i", "j")


AB = """, k AS (SELECT *, row_number() OVER (PARTITION BY scene, image_id ORDER BY response DESC, x, y) - 1 AS r FROM keypoints),
    a AS (SELECT scene, CAST(r AS INT) AS i, x, y, response, descriptor FROM k WHERE image_id = '0'), b AS (SELECT scene, CAST(r AS INT) AS j, x, y, response, descriptor FROM k WHERE image_id = '1')"""
FLAGS = AB + """, m AS (SELECT a.scene, a.i, min(b.j) AS j FROM a JOIN b ON a.scene = b.scene AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 3600 GROUP BY ALL),
    f AS (SELECT a.scene, a.i, CAST(coalesce(m.j, (SELECT count(*) FROM b WHERE b.scene = a.scene)) AS INT) AS j, m.j IS NOT NULL AS repeated FROM a LEFT JOIN m USING (scene, i)),
    p AS (SELECT scene, i, j, repeated AND j <= i AS repeated, sum(CAST(repeated AND j <= i AS INT)) OVER (PARTITION BY scene ORDER BY i) AS hits FROM f)"""


def flags(s, d):
    return M.first_match(first(s, d), second(s, d), 60.0, BY)


def early(s, d):
    return M.early(flags(s, d))


register("srt01_ranked", lambda s, d: K.top_n(A.keypoints(s, d), None, ["scene", "image_id"]).select("scene", "image_id", "kp_id", "rank"),
         " SELECT scene, image_id, kp_id, CAST(row_number() OVER (PARTITION BY scene, image_id ORDER BY response DESC, x, y) AS INT) AS rank FROM keypoints", "keypoints")
register("srt02_top_n", lambda s, d: K.top_n(A.keypoints(s, d), 5, ["scene"]).select("scene", "kp_id", "rank"),
         " SELECT scene, kp_id, rank FROM (SELECT scene, kp_id, CAST(row_number() OVER (PARTITION BY scene ORDER BY response DESC, x, y) AS INT) AS rank FROM keypoints) WHERE rank <= 5", "keypoints")
register("flt01_inside", lambda s, d: K.inside(A.keypoints(s, d), 600, 500).select("kp_id"), " SELECT kp_id FROM keypoints WHERE NOT (x < 0 OR x > 600 OR y < 0 OR y > 500)", "keypoints")
register("flt02_off_border", lambda s, d: K.off_border(A.keypoints(s, d), 1000, 1000, 400).select("kp_id"), " SELECT kp_id FROM keypoints WHERE NOT (x < 400 OR x > 600 OR y < 400 OR y > 600)", "keypoints")
register("jn02_first_match", flags, FLAGS + " SELECT * FROM f", "keypoints")
register("jn03_repeated_pairs", lambda s, d: M.repeated_pairs(first(s, d), second(s, d), 60.0, 20, BY), FLAGS + " SELECT scene, i, j FROM f WHERE repeated AND i <= 20 AND j <= 20", "keypoints")
register("win03_running_precision", lambda s, d: M.running_precision(early(s, d), BY),
         FLAGS + " SELECT scene, i, j, repeated, CAST(hits AS BIGINT) AS hits, hits / (i + 1) AS precision FROM p", "keypoints")
AP = FLAGS + """, ap AS (SELECT scene, CASE WHEN count(*) FILTER (repeated) >= 5 THEN coalesce(sum(hits / (i + 1)) FILTER (repeated AND hits <= 5), 0) / 5 ELSE 0 END::DOUBLE AS ap FROM p GROUP BY scene)"""
register("agg10_average_precision", lambda s, d: M.average_precision(early(s, d), 5, BY), AP + " SELECT * FROM ap", "keypoints")
register("agg16_repeated", lambda s, d: early(s, d).groupBy("scene").agg(F.count_if("repeated").alias("n")), FLAGS + " SELECT scene, count(*) FILTER (repeated) AS n FROM p GROUP BY scene", "keypoints")
CURVE = """, {p} AS (SELECT a.scene, a.{i} AS i, b.{j} AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 90000 AS near,
      list_sum(list_transform(range(1, 65), lambda q: (a.descriptor[q] - b.descriptor[q]) * (a.descriptor[q] - b.descriptor[q]))) AS fd FROM {a} a JOIN {b} b ON a.scene = b.scene WHERE a.{i} < 12 AND b.{j} < 12),
    {p}r AS (SELECT scene, i, j, arg_min(near, [fd, -j]) OVER w AS correct, max(CAST(near AS INT)) OVER w AS anyone FROM {p} WINDOW w AS (PARTITION BY scene, i ORDER BY j)),
    {p}c AS (SELECT scene, j + 1 AS k, sum(anyone) / (j + 1) AS repeated, count(*) FILTER (correct) / (j + 1) AS matched FROM {p}r WHERE j >= i GROUP BY scene, j)"""
ONE, TWO = CURVE.format(p="e", a="a", b="b", i="i", j="j"), CURVE.format(p="w", a="b", b="a", i="j", j="i")


def curves(s, d):
    return M.symmetric_matches(first(s, d), second(s, d), 300.0, 12, BY)


SYM = AB + ONE + TWO + ", sy AS (SELECT ec.scene, ec.k, (ec.repeated + wc.repeated) * 0.5::DOUBLE AS repeated, (ec.matched + wc.matched) * 0.5::DOUBLE AS matched FROM ec JOIN wc USING (scene, k))"
register("jn04_prefix_matches", lambda s, d: M.prefix_matches(first(s, d), second(s, d), 300.0, 12, BY), AB + ONE + " SELECT scene, k, repeated::DOUBLE AS repeated, matched::DOUBLE AS matched FROM ec", "keypoints")
register("jn05_symmetric_matches", curves, SYM + " SELECT * FROM sy", "keypoints")
register("agg12_mean_curve", lambda s, d: M.mean_curve(curves(s, d)), SYM + " SELECT k, sum(repeated) / count(*) AS repeated, sum(matched) / count(*) AS matched FROM sy GROUP BY k", "keypoints")
register("agg14_mean_curve_by_scene", lambda s, d: M.mean_curve(curves(s, d), BY), SYM + " SELECT scene, k, repeated, matched FROM sy", "keypoints")
COVER = AB + """, dd AS (SELECT p.scene, p.i, q.i AS j, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM a p JOIN a q ON p.scene = q.scene AND p.i <> q.i WHERE p.i < 15 AND q.i < 15),
    ci AS (SELECT scene, i, sum(1 / d) / 14 AS inv FROM dd GROUP BY scene, i), cv AS (SELECT scene, CASE WHEN count(*) >= 15 THEN 15 / sum(inv) END AS coverage FROM ci GROUP BY scene)"""
register("jn06_pair_distances", lambda s, d: M.pair_distances(first(s, d), 15, BY), COVER + " SELECT * FROM dd", "keypoints")
register("agg11_coverage", lambda s, d: M.coverage(first(s, d), 15, BY), COVER + " SELECT DISTINCT a.scene, cv.coverage FROM a LEFT JOIN cv USING (scene)", "keypoints")
register("jn07_least_distance", lambda s, d: M.least_distance(first(s, d), second(s, d), BY),
         AB + " SELECT a.scene, least(10000, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) FILTER (a.x <> b.x OR a.y <> b.y))::DOUBLE AS d FROM a JOIN b USING (scene) GROUP BY a.scene", "keypoints")


def metrics(s, d):
    return M.average_precision(early(s, d), 5, BY).join(M.coverage(first(s, d), 15, BY), BY)


METRICS = AP + COVER[len(AB):] + ", me AS (SELECT scene, ap.ap, cv.coverage FROM ap LEFT JOIN cv USING (scene))"
register("agg13_scene_summary", lambda s, d: M.scene_summary(metrics(s, d)),
         METRICS + " SELECT scene, ap AS map, coverage FROM me UNION ALL SELECT 'Total', sum(ap) / count(*), sum(coverage) / count(coverage) FROM me", "keypoints")
register("agg15_overall", lambda s, d: M.overall(metrics(s, d).withColumn("ap", F.when(F.col("scene") != "3", F.col("ap")))),
         METRICS + " SELECT count(*) AS pairs, count(*) FILTER (scene = '3') AS failed, sum(CASE WHEN scene <> '3' THEN ap END) / count(*) AS map FROM me", "keypoints")
# The same at the reference's sizes: 1000 points for curves, 100 repeated ones for precision, 200 points for coverage and repeated pairs, 5000 for reprojection.


def sized(sql, *sizes):
    for old, new in sizes:
        assert old in sql
        sql = sql.replace(old, new)
    return sql


def full_curves(s, d):
    return M.symmetric_matches(first(s, d), second(s, d), 300.0, 1000, BY)


def full_metrics(s, d):
    return M.average_precision(early(s, d), 100, BY).join(M.coverage(first(s, d), 200, BY), BY)


FULL_ONE, FULL_SYM = sized(ONE, ("< 12", "< 1000")), sized(SYM, ("< 12", "< 1000"))
FULL_AP = sized(AP, (">= 5 ", ">= 100 "), ("<= 5)", "<= 100)"), ("/ 5 ", "/ 100 "))
FULL_COVER = sized(COVER, ("< 15", "< 200"), ("/ 14", "/ 199"), (">= 15", ">= 200"), ("THEN 15 ", "THEN 200 "))
FULL_METRICS = FULL_AP + FULL_COVER[len(AB):] + METRICS[len(AP) + len(COVER[len(AB):]):]
# the reference takes the first 200 points, but a match's rank may be 200
register("jn03_repeated_pairs_full", lambda s, d: M.repeated_pairs(first(s, d), second(s, d), 60.0, 200, BY).filter("i < 200"), FLAGS + " SELECT scene, i, j FROM f WHERE repeated AND i < 200 AND j <= 200", "keypoints")
register("jn04_prefix_matches_full", lambda s, d: M.prefix_matches(first(s, d), second(s, d), 300.0, 1000, BY), AB + FULL_ONE + " SELECT scene, k, repeated::DOUBLE AS repeated, matched::DOUBLE AS matched FROM ec", "keypoints")
register("jn05_symmetric_matches_full", full_curves, FULL_SYM + " SELECT * FROM sy", "keypoints")
register("jn06_pair_distances_full", lambda s, d: M.pair_distances(first(s, d), 200, BY), FULL_COVER + " SELECT * FROM dd", "keypoints")
register("agg10_average_precision_full", lambda s, d: M.average_precision(early(s, d), 100, BY), FULL_AP + " SELECT * FROM ap", "keypoints")
register("agg11_coverage_full", lambda s, d: M.coverage(first(s, d), 200, BY), FULL_COVER + " SELECT DISTINCT a.scene, cv.coverage FROM a LEFT JOIN cv USING (scene)", "keypoints")
register("agg12_mean_curve_full", lambda s, d: M.mean_curve(full_curves(s, d)), FULL_SYM + " SELECT k, sum(repeated) / count(*) AS repeated, sum(matched) / count(*) AS matched FROM sy GROUP BY k", "keypoints")
register("agg13_scene_summary_full", lambda s, d: M.scene_summary(full_metrics(s, d)),
         FULL_METRICS + " SELECT scene, ap AS map, coverage FROM me UNION ALL SELECT 'Total', sum(ap) / count(*), sum(coverage) / count(coverage) FROM me", "keypoints")
register("agg14_mean_curve_by_scene_full", lambda s, d: M.mean_curve(full_curves(s, d), BY), FULL_SYM + " SELECT scene, k, repeated, matched FROM sy", "keypoints")
register("agg15_overall_full", lambda s, d: M.overall(full_metrics(s, d).withColumn("ap", F.when(F.col("scene") != "3", F.col("ap")))),
         FULL_METRICS + " SELECT count(*) AS pairs, count(*) FILTER (scene = '3') AS failed, sum(CASE WHEN scene <> '3' THEN ap END) / count(*) AS map FROM me", "keypoints")
PROJ = """, h AS (SELECT scene, kp_id, response, x, y, (1.02 * x + 0.01 * y - 3) / (0.00001 * x + 0.00002 * y + 1) AS px, (-0.015 * x + 0.99 * y + 4) / (0.00001 * x + 0.00002 * y + 1) AS py FROM keypoints)"""
register("scl07_project", lambda s, d: A.keypoints(s, d).select("kp_id", *[F.round(c, 6).alias(n) for c, n in zip(scalar.project(H, F.col("x"), F.col("y")), ("px", "py"), strict=True)]),
         PROJ + " SELECT kp_id, round(px, 6) AS px, round(py, 6) AS py FROM h", "keypoints")
register("jn12_reproject", lambda s, d: K.reproject(A.keypoints(s, d), H, 800, 700, 30, BY).select("scene", "kp_id", "i"),
         PROJ + " SELECT * FROM (SELECT scene, kp_id, CAST(row_number() OVER (PARTITION BY scene ORDER BY response DESC, x, y) - 1 AS INT) AS i FROM h WHERE NOT (px < 0 OR px > 800 OR py < 0 OR py > 700)) WHERE i < 30", "keypoints")
register("jn12_reproject_full", lambda s, d: K.reproject(A.keypoints(s, d), H, 800, 700, 5000, BY).select("scene", "kp_id", "i"),
         PROJ + " SELECT * FROM (SELECT scene, kp_id, CAST(row_number() OVER (PARTITION BY scene ORDER BY response DESC, x, y) - 1 AS INT) AS i FROM h WHERE NOT (px < 0 OR px > 800 OR py < 0 OR py > 700)) WHERE i < 5000", "keypoints")
register("jn12_reproject_padded", lambda s, d: K.reproject(A.keypoints(s, d), H, 800, 700, 30, BY, 200).groupBy("scene").agg(F.count("*").alias("n"), F.count_if(F.col("response").isNull()).alias("padding")),
         PROJ + " SELECT scene, 200::BIGINT AS n, 200 - least(30, count(*) FILTER (NOT (px < 0 OR px > 800 OR py < 0 OR py > 700))) AS padding FROM h GROUP BY scene", "keypoints")
register("snk08_status", lambda s, d: K.status(first(s, d), flags(s, d).filter("repeated"), 800, 700, BY).groupBy("scene", "status").agg(F.count("*").alias("n")),
         FLAGS + " SELECT a.scene, CAST(CASE WHEN a.x > 800 OR a.y > 700 THEN 1 WHEN f.repeated THEN 2 ELSE 0 END AS INT) AS status, count(*) AS n FROM a JOIN f USING (scene, i) GROUP BY ALL", "keypoints")
register("jn10_size_from_endpoints", lambda s, d: K.size_from_endpoints(A.event_raster(s, d).filter("v > 2"), A.event_raster(s, d).filter("v > 4").withColumn("distance", F.col("v"))),
         " SELECT a.image_id, a.x, a.y, a.v, CASE WHEN a.v > 4 THEN a.v END AS size FROM event_raster a WHERE a.v > 2", "event_raster")
register("jn11_image_pairs", lambda s, d: M.image_pairs(A.keypoints(s, d).select("scene", (F.col("image_id").cast("int") + 1).alias("image_no")).distinct()),
         " SELECT DISTINCT scene, CAST(image_id AS INT) AS pair_no FROM keypoints WHERE image_id = '1'", "keypoints")
