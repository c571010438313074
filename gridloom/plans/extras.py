"""Queries of detectors, trees and smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import adapters as A
from gridloom.functions import scalar
from gridloom.operators import components as C
from gridloom.operators import detectors as K
from gridloom.operators import distance as D
from gridloom.operators import match
from gridloom.operators import signal as G
from gridloom.operators import stencil as S
from gridloom.operators import trees
from gridloom.plans import matching
from gridloom.plans.registry import register
from gridloom.sources import writers as O

for name in ("skeleton", "skeleton_scale", "fast"):
    register(f"udf01_detect_{name}", lambda s, d, name=name: K.detect(A.embed_raster(s, d) if name == "fast" else A.part_raster(s, d), name, 8, 50))
register("udf04_harris_corners", lambda s, d: K.detect(A.part_raster(s, d), "harris", 8, 20))
register(
    "agg22_subtree_sums",
    lambda s, d: trees.subtree_sums(s.range(200).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.expr("(id - 1) div 3")).alias("parent"), (F.col("id") % 7).alias("value"))),
    """WITH RECURSIVE n AS (SELECT i AS node, CASE WHEN i > 0 THEN (i - 1) // 3 END AS parent, i % 7 AS value FROM range(200) t(i)),
    r AS (SELECT node AS top, node, value FROM n UNION ALL SELECT r.top, n.node, n.value FROM r JOIN n ON n.parent = r.node)
    SELECT top AS node, count(*) - 1 AS descendants, CAST(sum(value) AS BIGINT) AS total FROM r GROUP BY top""",
)
register("nbr07_thin_double", lambda s, d: S.thin_double(A.event_raster(s, d).withColumn("v", F.when(F.col("v") >= 4, 255.0).otherwise(0.0))))
register(
    "flt11_threshold_gradient",
    lambda s, d: S.threshold_gradient(A.event_raster(s, d), 4.0).withColumn("strongest", F.coalesce("strongest", F.lit(False))),
    """ SELECT image_id, x, y, v > 4 AS skeleton, coalesce(v > 4 AND row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) = 1, false) AS strongest FROM event_raster""",
    "event_raster",
)
register(
    "flt07_adjacent",
    lambda s, d: A.event_raster(s, d).filter("v > 5").select("image_id", "x", "y", S.adjacent(F.col("x"), F.col("y"), F.lit(10), F.lit(10)).alias("adjacent")),
    " SELECT image_id, x, y, abs(x - 10) <= 1 AND abs(y - 10) <= 1 AND NOT (x = 10 AND y = 10) AS adjacent FROM event_raster WHERE v > 5",
    "event_raster",
)
register(
    "snk15_flag_colours",
    lambda s, d: O.flag_colours(D.flags(A.event_raster(s, d), 2)).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n")),
    """, f AS (SELECT image_id, x, y, v >= 2 AS fg FROM event_raster),
    e AS (SELECT image_id, fg, fg AND NOT (coalesce(lead(fg) OVER r, false) AND coalesce(lag(fg) OVER r, false) AND coalesce(lead(fg) OVER c, false) AND coalesce(lag(fg) OVER c, false)) AS edge
      FROM f WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))
    SELECT image_id, CASE WHEN fg THEN 1.0 ELSE 0.0 END::DOUBLE AS r, CASE WHEN fg AND NOT edge THEN 1.0 ELSE 0.0 END::DOUBLE AS g, CASE WHEN fg AND NOT edge THEN 1.0 ELSE 0.0 END::DOUBLE AS b, count(*) AS n FROM e GROUP BY ALL""",
    "event_raster",
)
register(
    "snk13_scene_curves",
    lambda s, d: match.mean_curve(matching.curves(s, d), ["scene"]).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("k", F.round("repeated", 9).alias("v")))).alias("c")).select(
        "scene", F.array_join(F.transform("c", lambda x: F.format_number(x["v"], 6)), ",").alias("line")),
    matching.SYM + " SELECT scene, string_agg(printf('%.6f', repeated), ',' ORDER BY k) AS line FROM sy GROUP BY scene",
    "keypoints",
)
register(
    "top02_pairs_by_threshold",
    lambda s, d: G.persistence_pairs(A.signal(s, d), 5.0).groupBy("series_id").agg(F.count("*").alias("n"), F.min("persistence").alias("least")),
)
register(
    "set04_extrema_union",
    lambda s, d: A.signal(s, d).groupBy("series_id").agg(F.collect_set(F.when(F.col("v") > 6, F.col("idx"))).alias("high"), F.collect_set(F.when(F.col("v") < 3, F.col("idx"))).alias("low"))
    .select("series_id", F.size(F.array_union("high", "low")).alias("both"), F.arrays_overlap("high", "low").alias("overlap")),
    " SELECT series_id, CAST(count(*) FILTER (v > 6 OR v < 3) AS INT) AS both, false AS overlap FROM signal GROUP BY series_id",
    "signal",
)
register(
    "agg23_counters",
    lambda s, d: match.overall(matching.metrics(s, d).withColumn("ap", F.when(F.col("coverage") > 0, F.col("ap")))).select("pairs", "failed"),
    " SELECT count(DISTINCT scene) AS pairs, 0::BIGINT AS failed FROM keypoints",
    "keypoints",
)
register(
    "scl10_guarded_divide",
    lambda s, d: A.event_raster(s, d).select("image_id", "x", "y", scalar.guarded_divide(F.col("v"), (F.col("x") % 3).cast("double")).alias("q")),
    " SELECT image_id, x, y, CASE WHEN x % 3 > 0 THEN v / (x % 3) ELSE v END AS q FROM event_raster",
    "event_raster",
)
register(
    "scl01_distance",
    lambda s, d: A.keypoints(s, d).select("kp_id", F.round(scalar.distance(F.col("x"), F.col("y"), F.lit(500.0), F.lit(400.0)), 6).alias("d")),
    " SELECT kp_id, round(sqrt((x - 500) ** 2 + (y - 400) ** 2), 6) AS d FROM keypoints",
    "keypoints",
)
register(
    "scl03_safe_acos",
    lambda s, d: A.keypoints(s, d).select("kp_id", F.round(scalar.safe_acos(F.col("response") * 8), 6).alias("a")),
    " SELECT kp_id, round(acos(least(1, greatest(-1, response * 8))), 6) AS a FROM keypoints",
    "keypoints",
)
