"""Queries of components, distances, skeletons, signals, bytes, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import adapters as A
from gridloom.functions import scalar
from gridloom.operators import bytes as B
from gridloom.operators import components as C
from gridloom.operators import distance as D
from gridloom.operators import raster as R
from gridloom.operators import signal as G
from gridloom.operators import stencil as S
from gridloom.operators import trace as T
from gridloom.plans.registry import register


def binary(s, d):
    return R.threshold_inverse(A.event_raster(s, d), 3)


COMP = """, RECURSIVE b AS (SELECT image_id, x, y, CASE WHEN v >= 3 THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM event_raster),
    nb AS (SELECT p.image_id, p.y * 1000 + p.x AS k, q.y * 1000 + q.x AS n FROM b p JOIN b q ON q.image_id = p.image_id AND q.v = p.v AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1{four}),
    r(image_id, k, root) USING KEY (image_id, k) AS (SELECT DISTINCT image_id, k, k FROM nb
      UNION (SELECT u.image_id, u.k, min(w.root) FROM recurring.r u JOIN nb ON nb.image_id = u.image_id AND nb.k = u.k JOIN r w ON w.image_id = nb.image_id AND w.k = nb.n WHERE w.root < u.root GROUP BY u.image_id, u.k)),
    c AS (SELECT image_id, k, root FROM r),
    l AS (SELECT b.image_id, b.x, b.y, b.v, CAST(dense_rank() OVER (PARTITION BY b.image_id ORDER BY c.root) - 1 AS INT) AS component FROM b JOIN c ON c.image_id = b.image_id AND c.k = b.y * 1000 + b.x)"""
EIGHT, FOUR = COMP.format(four=""), COMP.format(four=" AND abs(q.x - p.x) + abs(q.y - p.y) <= 1")
register("grf01_components", lambda s, d: C.label(binary(s, d)), EIGHT + " SELECT * FROM l", "event_raster")
register("grf01_components_4", lambda s, d: C.label(binary(s, d), eight=False), FOUR + " SELECT * FROM l", "event_raster")
SPARSE = ", RECURSIVE b AS (SELECT image_id, x, y, 1.0::DOUBLE AS v FROM event_raster WHERE v >= 6)" + EIGHT[EIGHT.index(",\n    nb AS") :]
register(
    "grf01_propagated",
    lambda s, d: C.propagate(A.event_raster(s, d).filter("v >= 6").withColumn("v", F.lit(1.0))).groupBy("image_id").agg(F.countDistinct("component").alias("n")),
    SPARSE + " SELECT image_id, count(DISTINCT component) AS n FROM l GROUP BY image_id",
    "event_raster",
)
register("agg06_component_sizes", lambda s, d: C.sizes(C.label(binary(s, d))), EIGHT + " SELECT image_id, component, count(*) AS n, min(v) AS v FROM l GROUP BY ALL", "event_raster")
register(
    "flt06_drop_small",
    lambda s, d: C.drop_small(C.label(binary(s, d)), 4).select(*S.KEY),
    EIGHT + " SELECT image_id, x, y FROM (SELECT *, count(*) OVER (PARTITION BY image_id, component) AS n FROM l) WHERE n >= 4",
    "event_raster",
)
register(
    "grf03_layer_islands",
    lambda s, d: C.remove_layer_islands(binary(s, d), 1),
    EIGHT + " SELECT image_id, x, y, CASE WHEN n < 7.2 THEN 255 - v ELSE v END AS v FROM (SELECT *, count(*) OVER (PARTITION BY image_id, component) AS n FROM l)",
    "event_raster",
)
register(
    "grf13_tagged_clusters",
    lambda s, d: C.label(A.event_raster(s, d).withColumn("v", F.when(F.col("v") >= 2, 1.0).otherwise(0.0)), eight=False).filter("v > 0").groupBy("image_id").agg(F.countDistinct("component").alias("clusters")),
    FOUR.replace("v >= 3", "v >= 2") + " SELECT image_id, count(DISTINCT component) AS clusters FROM l WHERE v > 0 GROUP BY image_id",
    "event_raster",
)
register("grf02_remove_islands", lambda s, d: C.remove_islands(A.part_raster(s, d), 0.5))
register(
    "grf04_strongest",
    lambda s, d: C.strongest_per_component(
        C.label(binary(s, d), eight=False).join(A.event_raster(s, d).select(*S.KEY, F.col("v").alias("importance")), S.KEY).withColumn("skeleton", (F.col("x") + F.col("y")) % 2 == 0)
    ).select("image_id", "component", "importance"),
    FOUR + " SELECT l.image_id, l.component, max(e.v) AS importance FROM l JOIN event_raster e USING (image_id, x, y) WHERE (l.x + l.y) % 2 = 0 AND e.v > 0 GROUP BY ALL",
    "event_raster",
)
register(
    "grf10_seed_component",
    lambda s, d: C.seed_component(C.label(binary(s, d)), A.event_raster(s, d).select("image_id", F.lit(5).alias("x"), F.lit(7).alias("y")).distinct()).select(*S.KEY),
    EIGHT + " SELECT l.image_id, l.x, l.y FROM l JOIN l q ON q.image_id = l.image_id AND q.component = l.component AND q.x = 5 AND q.y = 7",
    "event_raster",
)
register(
    "grf11_flood_4",
    lambda s, d: C.seed_component(C.label(binary(s, d), eight=False), A.event_raster(s, d).select("image_id", F.lit(5).alias("x"), F.lit(7).alias("y")).distinct()).select(*S.KEY),
    FOUR + " SELECT l.image_id, l.x, l.y FROM l JOIN l q ON q.image_id = l.image_id AND q.component = l.component AND q.x = 5 AND q.y = 7",
    "event_raster",
)
register(
    "grf12_flood_points",
    lambda s, d: C.seed_points(C.label(binary(s, d), eight=False), A.event_raster(s, d).select("image_id", F.lit(5).alias("x"), F.lit(7).alias("y")).distinct()).select(
        "image_id", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("points")
    ),
    FOUR + " SELECT l.image_id, string_agg(l.x || ' ' || l.y, ',' ORDER BY l.y, l.x) AS points FROM l JOIN l q ON q.image_id = l.image_id AND q.component = l.component AND q.x = 5 AND q.y = 7 GROUP BY l.image_id",
    "event_raster",
)
# neighbours whose values differ by one at most
NEAR = FOUR.replace("CASE WHEN v >= 3 THEN 255.0 ELSE 0.0 END::DOUBLE AS v", "v").replace("q.v = p.v", "abs(q.v - p.v) <= 1")
register("udf07_label_near", lambda s, d: C.label(A.event_raster(s, d), eight=False, same=lambda a, b: abs(a - b) <= 1), NEAR + " SELECT * FROM l", "event_raster")
register(
    "agg07_highest_level",
    lambda s, d: R.layers(A.event_raster(s, d), [1, 3, 5]).filter("fg").groupBy("image_id", "x", "y").agg(F.max("level").alias("level")),
    " SELECT image_id, x, y, max(l) AS level FROM event_raster, (VALUES (1), (3), (5)) t(l) WHERE v >= l GROUP BY ALL",
    "event_raster",
)
register(
    "set03_mask_intersection",
    lambda s, d: A.event_raster(s, d).filter("v > 1").select(*S.KEY).intersect(A.event_raster(s, d).filter("v < 4").select(*S.KEY)),
    " SELECT image_id, x, y FROM event_raster WHERE v > 1 AND v < 4",
    "event_raster",
)


# distances
def layer(s, d):
    return D.boundary(R.layers(A.event_raster(s, d), [2, 4]))


EDGE = """, f AS (SELECT image_id, l AS level, x, y, v >= l AS fg FROM event_raster, (VALUES (2), (4)) t(l)),
    e AS (SELECT image_id, level, x, y, fg, fg AND NOT (coalesce(lead(fg) OVER r, false) AND coalesce(lag(fg) OVER r, false) AND coalesce(lead(fg) OVER c, false) AND coalesce(lag(fg) OVER c, false)) AS edge
      FROM f WINDOW r AS (PARTITION BY image_id, level, y ORDER BY x), c AS (PARTITION BY image_id, level, x ORDER BY y)),
    n AS (SELECT e.image_id, e.level, e.x, e.y, min((e.x - q.x) * (e.x - q.x) + (e.y - q.y) * (e.y - q.y)) AS d2 FROM e LEFT JOIN e q ON q.edge AND q.image_id = e.image_id AND q.level = e.level GROUP BY ALL)"""
register("dst01_boundary", layer, EDGE + " SELECT * FROM e", "event_raster")
register(
    "dst13_flags",
    lambda s, d: D.flags(A.event_raster(s, d), 2),
    EDGE + " SELECT image_id, x, y, CASE WHEN NOT fg THEN 0 WHEN edge THEN 1 ELSE 2 END AS flag FROM e WHERE level = 2",
    "event_raster",
)
register("dst04_nearest_site", lambda s, d: D.nearest_site(layer(s, d)).select(*D.KEY, "d2"), EDGE + " SELECT * FROM n", "event_raster")
register(
    "dst05_distances",
    lambda s, d: D.distances(D.nearest_site(layer(s, d))).select(*D.KEY, F.round("dt", 9).alias("dt"), "dt_floor"),
    EDGE + " SELECT image_id, level, x, y, round(sqrt(d2), 9) AS dt, CAST(floor(sqrt(d2)) AS INT) AS dt_floor FROM n",
    "event_raster",
)
register("flt10_within", lambda s, d: D.within(D.nearest_site(layer(s, d)), 2).select(*D.KEY), EDGE + " SELECT image_id, level, x, y FROM n WHERE d2 <= 4", "event_raster")
register("dst14_exact_distance", lambda s, d: D.exact_distance(R.layers(A.event_raster(s, d), [2, 4])), EDGE + " SELECT image_id, level, x, y, sqrt(d2) + 1 AS dt FROM n WHERE d2 IS NOT NULL", "event_raster")
register(
    "dst17_wrap_distance",
    lambda s, d: A.signal(s, d).select("series_id", "idx", scalar.wrap_distance(F.col("v") - 8, F.lit(10.0)).alias("w")),
    " SELECT series_id, idx, least(abs(v - 8), abs(10 - abs(v - 8))) AS w FROM signal",
    "signal",
)


def labelled_sites(s, d):
    sites = D.nearest_site(layer(s, d))
    return sites.filter("d2 IS NOT NULL").withColumn("label", (F.col("sx") * 7 + F.col("sy") * 13).cast("double")).withColumn("length", F.lit(300.0))


def toy_field(s, d):
    """A label by place stands in for the arc length, so that SQL can follow."""
    rows = A.event_raster(s, d).select("image_id", F.lit(1).alias("level"), "x", "y", (F.col("x") % 3 + F.col("y") % 2).alias("d2"), (F.col("v") * 7).alias("label"), F.lit(40.0).alias("length"))
    return D.importance(rows)


TOY = """, t AS (SELECT image_id, 1 AS level, x, y, x % 3 + y % 2 AS d2, v * 7 AS label, 40.0::DOUBLE AS length FROM event_raster),
    g AS (SELECT *, abs(label - lead(label) OVER r) AS a, abs(label - lag(label) OVER r) AS b, abs(label - lead(label) OVER c) AS e, abs(label - lag(label) OVER c) AS f
      FROM t WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
    i AS (SELECT image_id, level, x, y, d2, label, length, CASE WHEN d2 > 0 AND a + b + e + f IS NOT NULL THEN least(abs(greatest(a, b, e, f)), abs(length - abs(greatest(a, b, e, f)))) END AS importance FROM g),
    m AS (SELECT *, importance / sqrt(CAST(d2 AS DOUBLE)) AS saliency FROM i)"""
register("dst07_importance", toy_field, TOY + " SELECT * FROM m", "event_raster")
register("flt04_skeleton", lambda s, d: D.skeleton(toy_field(s, d), 2.0).select(*D.KEY), TOY + " SELECT image_id, level, x, y FROM m WHERE saliency >= 2 AND importance > 1 AND NOT (importance < 5 AND sqrt(d2) < 1.5)", "event_raster")
register(
    "jn01_combine_skeletons",
    lambda s, d: D.combine_skeletons(D.skeleton(toy_field(s, d), 2.0), D.skeleton(toy_field(s, d), 3.0)).select(*D.KEY, "importance"),
    TOY + " SELECT image_id, level, x, y, importance FROM m WHERE saliency >= 3 AND importance > 1 AND NOT (importance < 5 AND sqrt(d2) < 1.5)",
    "event_raster",
)
# the nearest edge pixel's label, the first in rows on ties
SITES = EDGE + """, z AS (SELECT e.image_id, e.level, e.x, e.y, min((e.x - q.x) * (e.x - q.x) + (e.y - q.y) * (e.y - q.y)) AS d2,
      arg_min(q.x * 7 + q.y * 13, ((e.x - q.x) * (e.x - q.x) + (e.y - q.y) * (e.y - q.y)) * 1000000 + q.y * 1000 + q.x) AS label
      FROM e JOIN e q ON q.edge AND q.image_id = e.image_id AND q.level = e.level GROUP BY ALL),
    g AS (SELECT *, abs(label - lead(label) OVER r) AS a, abs(label - lag(label) OVER r) AS b, abs(label - lead(label) OVER c) AS s, abs(label - lag(label) OVER c) AS t
      FROM z WINDOW r AS (PARTITION BY image_id, level, y ORDER BY x), c AS (PARTITION BY image_id, level, x ORDER BY y)),
    i AS (SELECT image_id, level, x, y, d2, CAST(CASE WHEN d2 > 0 AND a + b + s + t IS NOT NULL THEN least(greatest(a, b, s, t), abs(300 - greatest(a, b, s, t))) END AS DOUBLE) AS importance FROM g)"""
register("jn09_site_labels", lambda s, d: D.importance(labelled_sites(s, d)).select(*D.KEY, "importance"), SITES + " SELECT image_id, level, x, y, importance FROM i", "event_raster")
register(
    "dst08_interpolation",
    lambda s, d: D.skeleton_interpolation(D.nearest_site(layer(s, d)), D.skeleton(D.importance(labelled_sites(s, d)), 1.0)).select(
        *D.KEY, *[F.round(c, 9).alias(c) for c in ("dt", "skeleton_dt", "b")]
    ),
    SITES
    + """, k AS (SELECT * FROM i WHERE importance / sqrt(d2) >= 1 AND importance > 1 AND NOT (importance < 5 AND sqrt(d2) < 1.5)),
    w AS (SELECT n.image_id, n.level, n.x, n.y, sqrt(n.d2) AS dt, sqrt(min((n.x - k.x) * (n.x - k.x) + (n.y - k.y) * (n.y - k.y))) AS sd
      FROM n LEFT JOIN k ON k.image_id = n.image_id AND k.level = n.level GROUP BY n.image_id, n.level, n.x, n.y, n.d2)
    SELECT image_id, level, x, y, round(dt, 9) AS dt, round(sd, 9) AS skeleton_dt, round(CASE WHEN dt > 0 THEN least(1.0, dt / (dt + sd)) ELSE 0.0 END, 9) AS b FROM w""",
    "event_raster",
)
register("grf07_endpoints", lambda s, d: T.endpoints(A.part_raster(s, d), 1.6, 1, 2))
register("udf02_skeleton_corners", lambda s, d: T.skeleton_corners(A.part_raster(s, d), margin=2))

# signals
register("top01_persistence", lambda s, d: G.persistence_pairs(A.signal(s, d), 2.0))
register("top03_extrema", lambda s, d: G.extrema(G.persistence_pairs(A.signal(s, d), 2.0)))
register("top04_global_minimum", lambda s, d: G.global_minimum(A.signal(s, d)), " SELECT series_id, arg_min(idx, v * 100000 + idx) AS idx, min(v) AS v FROM signal GROUP BY series_id", "signal")
register("srt05_by_value", lambda s, d: A.signal(s, d).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("v", "idx"))).alias("o")).select("series_id", F.posexplode("o").alias("rank", "s")).select("series_id", "rank", "s.v", "s.idx"),
         " SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY v, idx) - 1 AS INT) AS rank, v, idx FROM signal", "signal")
register("win01_peaks", lambda s, d: G.detect_peaks(A.signal(s, d), delta=4.0))
register("win02_peaks_of_count", lambda s, d: G.detect_peaks(A.signal(s, d), count=12))
register("win06_layers_of_count", lambda s, d: G.choose_layers(R.upper_levels(R.histogram(A.embed_raster(s, d))), 6))
register("win07_layers_by_maxima", lambda s, d: G.choose_layers(R.upper_levels(R.histogram(A.embed_raster(s, d))), 6, method="maxima"))

register(
    "win11_context",
    lambda s, d: G.exponential_context(A.signal(s, d)).withColumn("context", F.round("context", 6)),
    """, RECURSIVE n AS (SELECT series_id, idx, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS rn, CASE WHEN v < 1 THEN 0 ELSE length(bin(CAST(floor(v) AS BIGINT))) END AS bits FROM signal),
    c AS (SELECT series_id, rn, idx, bits, 0.0::DOUBLE AS ctx FROM n WHERE rn = 1
      UNION ALL SELECT n.series_id, n.rn, n.idx, n.bits, 0.9::DOUBLE * c.ctx + 0.2::DOUBLE * c.bits FROM c JOIN n ON n.series_id = c.series_id AND n.rn = c.rn + 1)
    SELECT series_id, idx, round(ctx, 6) AS context FROM c""",
    "signal",
)

# bytes
HIST = ", h AS (SELECT g.doc_id, g.byte, count(b.byte) AS n FROM (SELECT doc_id, CAST(r AS INT) AS byte FROM (SELECT DISTINCT doc_id FROM text_bytes), range(256) t(r)) g LEFT JOIN text_bytes b ON b.doc_id = g.doc_id AND b.byte = g.byte GROUP BY ALL)"
register("agg20_byte_histogram", lambda s, d: B.histogram(A.text_bytes(s, d)), HIST + " SELECT * FROM h", "text_bytes")
register("agg20_least_common", lambda s, d: B.least_common(A.text_bytes(s, d)), HIST + " SELECT doc_id, arg_min(byte, n * 256 + byte) AS byte FROM h GROUP BY doc_id", "text_bytes")
register("srt07_by_count", lambda s, d: B.by_count(A.text_bytes(s, d)), HIST + " SELECT doc_id, byte, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, byte) AS INT) AS rank FROM h WHERE n > 0", "text_bytes")
register(
    "agg21_entropy",
    lambda s, d: B.entropy(A.text_bytes(s, d)).withColumn("entropy", F.round("entropy", 9)),
    HIST + " SELECT doc_id, round(log2(sum(n)) - sum(CASE WHEN n > 0 THEN n * log2(n) ELSE 0 END) / sum(n), 9) AS entropy FROM h GROUP BY doc_id",
    "text_bytes",
)
RUNS = """, i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, byte ORDER BY pos) AS island FROM text_bytes),
    r AS (SELECT doc_id, min(pos) AS start, byte, CAST(count(*) AS INT) AS length FROM i GROUP BY doc_id, byte, island)"""
register("win10_runs", lambda s, d: B.run_lengths(A.text_bytes(s, d)),
         RUNS + " SELECT doc_id, byte, length, count(*) AS n, min(start) AS first FROM r GROUP BY ALL", "text_bytes")
register(
    "cod01_run_length_size",
    lambda s, d: B.run_length_size(A.text_bytes(s, d)),
    HIST + RUNS + """, m AS (SELECT doc_id, arg_min(byte, n * 256 + byte) AS marker FROM h GROUP BY doc_id)
    SELECT doc_id, CAST(1 + sum(CASE WHEN length <= 3 THEN CASE WHEN byte = marker THEN 2 ELSE length END WHEN length > 128 THEN 4 ELSE 3 END) AS BIGINT) AS size FROM r JOIN m USING (doc_id) GROUP BY doc_id""",
    "text_bytes",
)
RICE = """, n AS (SELECT *, CASE WHEN byte = 0 THEN 0 ELSE length(bin(byte)) END AS nbits FROM text_bytes),
    k0 AS (SELECT doc_id, greatest(1, (sum(nbits) + count(*) // 2) // count(*)) AS k0 FROM n WHERE pos < 16 GROUP BY doc_id),
    k AS (SELECT n.*, CAST(CASE WHEN pos < 16 THEN k0 ELSE (sum(nbits) OVER (PARTITION BY n.doc_id ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) + 8) // 16 END AS INT) AS k FROM n JOIN k0 USING (doc_id))"""
register("win09_rice_k", lambda s, d: B.rice_code(A.text_bytes(s, d)).select("doc_id", "k", "nbits"),
         RICE + " SELECT doc_id, CAST(sum(k) AS BIGINT) AS k, CAST(sum(nbits) AS BIGINT) AS nbits FROM k GROUP BY doc_id", "text_bytes")
register(
    "cod04_rice_bits",
    lambda s, d: B.rice_code(A.text_bytes(s, d)).select("doc_id", "bits"),
    RICE + """, q AS (SELECT doc_id, k, byte >> k AS q FROM k)
    SELECT doc_id, CAST(8 + sum(k + CASE WHEN q < 8 THEN q + 1 WHEN q = 8 THEN 9 ELSE 8 + length(bin(q - 8)) + 1 + length(bin(q - 8)) - 1 END) AS BIGINT) AS bits FROM q GROUP BY doc_id""",
    "text_bytes",
)
register("scl16_adler32", lambda s, d: B.adler32(A.text_bytes(s, d)),
         " SELECT doc_id, CAST(((count(*) + sum((n - pos) * byte)) % 65521) * 65536 + (1 + sum(byte)) % 65521 AS BIGINT) AS adler FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM text_bytes) GROUP BY doc_id", "text_bytes")
PNG = """, p AS (SELECT image_id, x, y, CAST(v AS INT) AS v, CAST(coalesce(lag(v) OVER r, 0) AS INT) AS a, CAST(coalesce(lag(v) OVER c, 0) AS INT) AS b FROM embed_raster
      WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
    q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS c FROM p)"""
for kind, guess in {
    "sub": "a", "up": "b", "average": "(a + b) // 2",
    "paeth": "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END",
}.items():
    register(f"cod14_filter_{kind}", lambda s, d, kind=kind: B.filter_rows(A.embed_raster(s, d), kind), PNG + f" SELECT image_id, x, y, (v - ({guess}) + 256) % 256 AS v FROM q", "embed_raster")
register("cod15_interlace", lambda s, d: B.interlace_pass(A.part_raster(s, d)).groupBy("image_id", "pass").agg(F.count("*").alias("n")),
         """ SELECT image_id, CASE WHEN y % 8 = 0 THEN CASE x % 8 WHEN 0 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 4 WHEN 6 THEN 4 ELSE 6 END WHEN y % 8 = 4 THEN CASE WHEN x % 4 = 0 THEN 3 WHEN x % 4 = 2 THEN 4 ELSE 6 END
           WHEN y % 4 = 2 THEN CASE WHEN x % 2 = 0 THEN 5 ELSE 6 END ELSE 7 END AS pass, count(*) AS n FROM part_raster GROUP BY ALL""", "part_raster")  # fmt: skip


def dense_signal(s, d):
    return A.event_raster(s, d).select(F.col("image_id").alias("series_id"), (F.col("y") * 24 + F.col("x")).alias("idx"), "v")


register("cod10_wavelet_level", lambda s, d: B.wavelet_level(dense_signal(s, d)),
         """, g AS (SELECT image_id AS series_id, y * 24 + x AS idx, CAST(v AS INT) AS v FROM event_raster)
    SELECT a.series_id, a.idx // 2 AS i, (a.v + b.v) >> 1 AS low, a.v - b.v AS high FROM g a JOIN g b ON b.series_id = a.series_id AND b.idx = a.idx + 1 WHERE a.idx % 2 = 0""", "event_raster")  # fmt: skip

# scalar functions over whole columns
register("scl02_descriptor_distance", lambda s, d: A.keypoints(s, d).select("kp_id", F.round(scalar.descriptor_distance("descriptor", F.reverse("descriptor")), 9).alias("fd")),
         " SELECT kp_id, round(list_sum(list_transform(range(1, 65), lambda q: (descriptor[q] - descriptor[65 - q]) ** 2)), 9) AS fd FROM keypoints", "keypoints")
register("scl04_angle", lambda s, d: A.keypoints(s, d).select("kp_id", F.round(scalar.angle(F.col("x"), F.col("y"), F.lit(500.0), F.lit(500.0), F.lit(900.0), F.lit(300.0)), 6).alias("angle")),
         """ SELECT kp_id, round(acos(least(1, greatest(-1, ((500 - x) * -400 + (500 - y) * 200) / (sqrt((500 - x) ** 2 + (500 - y) ** 2) * sqrt(200000::DOUBLE) + 0.00001::DOUBLE)))), 6) AS angle FROM keypoints""", "keypoints")  # fmt: skip
register("scl05_buffer_size", lambda s, d: A.part_raster(s, d).select("x", "y").distinct().select("x", "y", scalar.buffer_size(F.col("x") + 1, F.col("y") + 1).alias("size")),
         " SELECT DISTINCT x, y, CAST(2 ** (floor(log2(greatest(x, y) + 1)) + 1) AS BIGINT) AS size FROM part_raster", "part_raster")
register("scl12_bit_length", lambda s, d: s.range(4096).select(F.col("id").alias("n"), scalar.bit_length(F.col("id")).alias("bits")),
         "SELECT i AS n, CAST(CASE WHEN i = 0 THEN 0 ELSE length(bin(i)) END AS INT) AS bits FROM range(4096) t(i)")


def _split(s, d):
    bits, data = scalar.split_integer(F.col("n"))
    return s.range(-2000, 2001).select(F.col("id").cast("int").alias("n")).select("n", bits.alias("bits"), data.alias("data")).withColumn("back", scalar.restore_integer(F.col("bits"), F.col("data")))


register("scl13_split_integer", _split,
         """SELECT CAST(i AS INT) AS n, CAST(b AS INT) AS bits, CAST(CASE WHEN i = 0 THEN 0 ELSE 2 * abs(i) - 2 ** b + CASE WHEN i < 0 THEN 1 ELSE 0 END END AS INT) AS data, CAST(i AS INT) AS back
    FROM (SELECT i, CASE WHEN i = 0 THEN 0 ELSE length(bin(abs(i))) END AS b FROM range(-2000, 2001) t(i))""")  # fmt: skip
register("scl14_buffer_crc", lambda s, d: A.text_bytes(s, d).select("doc_id", scalar.buffer_crc(B.values("data")).alias("crc")))
register("scl15_crc32", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.crc32("text").alias("crc")))
register("scl17_variable_size", lambda s, d: s.range(0, 300000, 37).select(F.col("id").alias("n"), scalar.variable_size(F.col("id")).alias("code")),
         """SELECT i AS n, CASE WHEN i < 128 THEN lpad(hex(i), 2, '0') WHEN i < 16384 THEN hex(i // 128 + 128) || lpad(hex(i % 128), 2, '0')
    ELSE hex(i // 16384 + 128) || hex(i // 128 % 128 + 128) || lpad(hex(i % 128), 2, '0') END AS code FROM range(0, 300000, 37) t(i)""")  # fmt: skip
register("scl19_little_endian", lambda s, d: s.range(0, 70000, 13).select(F.col("id").alias("n"), scalar.little_endian_hex(F.col("id")).alias("le"), scalar.swap_bytes(F.lpad(F.hex("id"), 8, "0")).alias("swapped")),
         "SELECT i AS n, le, le AS swapped FROM (SELECT i, lpad(hex(i % 256), 2, '0') || lpad(hex(i // 256 % 256), 2, '0') || lpad(hex(i // 65536), 2, '0') || '00' AS le FROM range(0, 70000, 13) t(i))")
register("prj17_filter_size", lambda s, d: s.range(1, 14).select(F.col("id").alias("n"), scalar.filter_size(F.col("id")).alias("size")),
         "SELECT i AS n, CASE WHEN i < 3 THEN 1 WHEN i < 5 THEN 3 WHEN i < 7 THEN 5 WHEN i < 9 THEN 7 ELSE 9 END AS size FROM range(1, 14) t(i)")
