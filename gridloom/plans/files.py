"""Queries of readers, writers and codecs: what goes out comes back."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from gridloom import adapters as A
from gridloom.operators import codecs as C
from gridloom.operators import marching as M
from gridloom.operators import match
from gridloom.operators import raster as R
from gridloom.plans import matching
from gridloom.plans.registry import register
from gridloom.sources import readers as I
from gridloom.sources import writers as O
from gridloom.functions import scalar


def files(df):
    return df.select(F.col("image_id").alias("path"), "content")


SAME = " SELECT image_id, x, y, v FROM {0}"
register("src05_pgm", lambda s, d: I.decode_images(files(O.to_pgm(A.embed_raster(s, d)))),
         " SELECT image_id, x, y, floor((v - min(v) OVER w) * 255.0::DOUBLE / (max(v) OVER w - min(v) OVER w)) AS v FROM embed_raster WINDOW w AS (PARTITION BY image_id)", "embed_raster")
register("src07_vtk", lambda s, d: I.decode_images(files(O.to_vtk(A.part_raster(s, d)))), SAME.format("part_raster"), "part_raster")
register("src08_ascii", lambda s, d: I.decode_images(files(O.to_ascii(A.event_raster(s, d)))), SAME.format("event_raster"), "event_raster")
register("src18_png", lambda s, d: I.decode_images(files(O.to_png(A.embed_raster(s, d)))), SAME.format("embed_raster"), "embed_raster")
register("src16_volume", lambda s, d: I.decode_volumes(files(O.to_ascii(A.event_raster(s, d)))), " SELECT image_id, x, y, 0 AS z, v FROM event_raster", "event_raster")
VOLUME = " SELECT image_id, x, y, z, v FROM event_volume"
register("src16_volume_slices", lambda s, d: I.decode_volumes(files(O.to_ascii(A.event_volume(s, d)))), VOLUME, "event_raster event_volume")
register("snk16_volume_vtk", lambda s, d: I.decode_volumes(files(O.to_vtk(A.event_volume(s, d)))), VOLUME, "event_raster event_volume")
register("snk16_slice_ppm", lambda s, d: I.decode_rgb(files(O.slice_to_ppm(A.event_volume(s, d), "z", 2))).groupBy("image_id").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y")),
         " SELECT image_id, count(*) AS n, max(x) AS x, max(y) AS y FROM event_volume WHERE z = 2 GROUP BY image_id", "event_raster event_volume")
register(
    "src03_sniff",
    lambda s, d: files(O.to_png(A.event_raster(s, d))).unionByName(files(O.to_pgm(A.event_raster(s, d)))).unionByName(files(O.to_vtk(A.event_raster(s, d)))).unionByName(files(O.to_ascii(A.event_raster(s, d))))
    .unionByName(files(O.to_rainbow_ppm(A.event_raster(s, d)))).select("path", I.sniff(F.col("content")).alias("kind")),
    " SELECT DISTINCT image_id AS path, k AS kind FROM event_raster, (VALUES ('png'), ('pgm'), ('vtk'), ('ascii'), ('ppm')) t(k)",
    "event_raster",
)
register("src09_ppm", lambda s, d: I.decode_rgb(files(O.to_rainbow_ppm(A.part_raster(s, d)))).select("image_id", "x", "y", *[F.round(F.col(c) * 255).cast("int").alias(c) for c in "rgb"]))
register("src10_homography", lambda s, d: I.homographies(s.createDataFrame([("a", " 1 0 10\n0 1 -5\n0\t0 1\n")], "name string, text string")).select("name", F.posexplode("h").alias("i", "v")),
         "SELECT 'a' AS name, CAST(i AS INT) AS i, [1, 0, 10, 0, 1, -5, 0, 0, 1][i + 1]::DOUBLE AS v FROM range(9) t(i)")
PATHS = ["d/graf/img1.ppm", "d/graf/img2.ppm", "d/graf/H1to2p", "d/wall/img12.png", "d/wall/H1to3p.txt", "d/wall/n.txt"]
register("src11_dataset", lambda s, d: I.dataset_files(s.createDataFrame([(p,) for p in PATHS], "path string"), "vgg").fillna(-1),
         """SELECT * FROM (VALUES ('graf', 'd/graf/img1.ppm', 'image', 1), ('graf', 'd/graf/img2.ppm', 'image', 2), ('graf', 'd/graf/H1to2p', 'homography', 2), ('wall', 'd/wall/img12.png', 'image', 12),
    ('wall', 'd/wall/H1to3p.txt', 'homography', 3), ('wall', 'd/wall/n.txt', 'other', -1)) t(scene, path, role, number)""")  # fmt: skip
NAMED = {"hp": ["d/v_a/1.ppm", "d/v_a/2.ppm", "d/v_a/H_1_2"], "ef": ["d/notre/img1.png", "d/notre/img3.png", "d/notre/H1to3p", "d/notre/n.txt"], "webcam": ["d/cam/img1.png", "d/cam/img2.png", "d/cam/H"]}
register("src13_dataset_kinds", lambda s, d: functools.reduce(lambda a, b: a.unionByName(b), [I.dataset_files(s.createDataFrame([(p,) for p in paths], "path string"), kind).withColumn("kind", F.lit(kind)) for kind, paths in NAMED.items()]).fillna(-1),
         """SELECT * FROM (VALUES ('v_a', 'd/v_a/1.ppm', 'image', 1, 'hp'), ('v_a', 'd/v_a/2.ppm', 'image', 2, 'hp'), ('v_a', 'd/v_a/H_1_2', 'homography', 2, 'hp'), ('notre', 'd/notre/img1.png', 'image', 1, 'ef'),
    ('notre', 'd/notre/img3.png', 'image', 3, 'ef'), ('notre', 'd/notre/H1to3p', 'homography', 3, 'ef'), ('notre', 'd/notre/n.txt', 'other', -1, 'ef'), ('cam', 'd/cam/img1.png', 'image', 1, 'webcam'), ('cam', 'd/cam/img2.png', 'image', 2, 'webcam'),
    ('cam', 'd/cam/H', 'homography', 0, 'webcam')) t(scene, path, role, number, kind)""")  # fmt: skip
register("src12_scene_sizes", lambda s, d: I.scene_sizes(A.keypoints(s, d).select("scene").distinct(), s.createDataFrame([("3", 4)], "scene string, n int")),
         " SELECT DISTINCT scene, CASE WHEN scene = '3' THEN 4 ELSE 6 END AS n FROM keypoints", "keypoints")
CONFIG = "# c\na = 1\ngrp = (\nb = %a%x\n)\nflag = Yes\n"


def settings(s, d):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([kv for t in pdf["text"] for kv in I.config(t).items()], columns=["name", "value"])

    return s.createDataFrame([(CONFIG,)], "text string").mapInPandas(run, "name string, value string")


register("src14_config", settings, "SELECT * FROM (VALUES ('a', '1'), ('grp.b', '1x'), ('flag', 'Yes')) t(name, value)")
register("src15_typed_settings", lambda s, d: settings(s, d).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m")).select(
    I.setting(F.col("m"), "flag", "bool").alias("flag"), I.setting(F.col("m"), "a", "int").alias("a"), I.setting(F.col("m"), "none", "double").alias("missing")),
    "SELECT true AS flag, 1 AS a, NULL::DOUBLE AS missing")
register(
    "src19_results",
    lambda s, d: I.read_results(O.curve_lines(match.mean_curve(matching.curves(s, d)), "Skel").withColumn("file", F.lit("f"))).select("file", "detector", "k", "value"),
    matching.SYM + " SELECT 'f' AS file, 'Skel' AS detector, CAST(k AS INT) AS k, sum(repeated) / count(*) AS value FROM sy GROUP BY k",
    "keypoints",
)
register(
    "src19_results_full",
    lambda s, d: I.read_results(O.curve_lines(match.mean_curve(matching.full_curves(s, d)), "Skel").withColumn("file", F.lit("f"))).select("file", "detector", "k", "value"),
    matching.FULL_SYM + " SELECT 'f' AS file, 'Skel' AS detector, CAST(k AS INT) AS k, sum(repeated) / count(*) AS value FROM sy GROUP BY k",
    "keypoints",
)
register("snk12_scene_lines", lambda s, d: O.scene_lines(match.scene_summary(matching.metrics(s, d)), "Skel").groupBy("part").agg(F.count("*").alias("n"), F.min(F.substring_index("text", ",", 1)).alias("first")),
         """ SELECT part, CAST(CASE WHEN part IN (1, 4) THEN (SELECT count(DISTINCT scene) FROM keypoints) WHEN part = 3 THEN 2 ELSE 1 END AS BIGINT) AS n,
    CASE part WHEN 0 THEN 'Skel' WHEN 1 THEN '0' WHEN 2 THEN 'Total' WHEN 3 THEN '' ELSE '0' END AS first FROM (VALUES (0), (1), (2), (3), (4)) t(part)""", "keypoints")  # fmt: skip
register("snk10_homography_text", lambda s, d: I.homographies(O.homography_text(s.createDataFrame([("a", [float(i) for i in range(9)])], "name string, h array<double>"))).select("name", F.posexplode("h").alias("i", "v")),
         "SELECT 'a' AS name, CAST(i AS INT) AS i, i::DOUBLE AS v FROM range(9) t(i)")
register("srt06_natural_sort", lambda s, d: s.range(30).select(F.concat(F.lit("img"), "id", F.lit(".png")).alias("name")).select("name", F.row_number().over(matching.Window.orderBy(I.natural_key(F.col("name")))).alias("n")),
         "SELECT 'img' || i || '.png' AS name, CAST(i + 1 AS INT) AS n FROM range(30) t(i)")
register("scl08_names", lambda s, d: s.createDataFrame([("a.b.txt",), ("none",), ("img12",)], "name string").select("name", scalar.file_extension(F.col("name")).alias("ext"), scalar.file_stem(F.col("name")).alias("stem"), F.coalesce(scalar.trailing_number(F.col("name")), F.lit(-1)).alias("number")),
         "SELECT * FROM (VALUES ('a.b.txt', 'txt', 'a.b', -1), ('none', '', '', -1), ('img12', '', '', 12)) t(name, ext, stem, number)")


def round_trip(codec):
    def run(s, d):
        docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("b"))
        back = C.decode(C.encode(docs, "b", codec), "code", codec)
        return back.select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), (F.col("b") == F.col("data")).alias("same"))

    return run


for codec, number in (("rle", "01"), ("huffman", "02"), ("shannon_fano", "03"), ("rice", "04"), ("lz_fast", "06"), ("arithmetic", "07"), ("arithmetic_static", "07"), ("arithmetic_bits", "07"), ("arithmetic_context", "09"), ("deflate", "12"), ("zlib", "13")):
    register(f"cod{number}_{codec}_round_trip", round_trip(codec), "SELECT doc_id, strlen(text) AS n_bytes, true AS same FROM documents")


def waves(s, d):
    """Each signal as a mono 16-bit wave file, through the coder and back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("idx")["v"].to_numpy().astype("<i2").tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(v), b"WAVE", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16, b"data", len(v))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "b": [head + v]})

    made = A.signal(s, d).groupBy("series_id").applyInPandas(run, "series_id string, b binary")
    back = C.decode(C.encode(made, "b", "wav"), "code", "wav")
    return back.select("series_id", F.octet_length("b").cast("long").alias("n_bytes"), (F.col("b") == F.col("data")).alias("same"))


register("cod11_wav_round_trip", waves, " SELECT series_id, 44 + 2 * count(*) AS n_bytes, true AS same FROM signal GROUP BY series_id", "signal")
register("dst10_marching", lambda s, d: M.distances(A.event_raster(s, d), 3).select("image_id", "x", "y", F.round("dt", 6).alias("dt")))
register("dst11_marching_origins", lambda s, d: M.distances(A.event_raster(s, d), 3, "one_point"))
register("dst16_skeleton_distance", lambda s, d: M.skeleton_distance(A.event_raster(s, d), A.event_raster(s, d).filter("v > 5"), 3))
register("dst21_eigen", lambda s, d: M.eigen_symmetric(A.keypoints(s, d).select("kp_id", F.array(F.array(F.lit(2.0), F.col("response")), F.array(F.col("response"), F.lit(1.0))).alias("m")), "m").select("kp_id", *[F.round(F.col("eigen.values")[i], 9).alias(n) for i, n in ((0, "large"), (1, "small"))]),
         " SELECT kp_id, round(1.5 + sqrt(0.25 + response * response), 9) AS large, round(1.5 - sqrt(0.25 + response * response), 9) AS small FROM keypoints", "keypoints")
register("dst21_eigen_2x2", lambda s, d: A.keypoints(s, d).select("kp_id", *[F.round(c, 9).alias(n) for c, n in zip(M.eigenvalues_2x2(F.lit(2.0), F.col("response"), F.lit(1.0)), ("large", "small"), strict=True)]),
         " SELECT kp_id, round(1.5 + sqrt(0.25 + response * response), 9) AS large, round(1.5 - sqrt(0.25 + response * response), 9) AS small FROM keypoints", "keypoints")
register("layout_subsampled_png", lambda s, d: I.decode_images(files(O.to_png(R.subsample(A.embed_raster(s, d), 2)))),
         " SELECT image_id, x // 2 AS x, y // 2 AS y, v FROM embed_raster WHERE x % 2 = 0 AND y % 2 = 0", "embed_raster")
