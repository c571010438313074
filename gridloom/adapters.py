"""Views of the driver's tables as rasters, keypoints, signals and byte strings, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import read_table


def _grid(images: DataFrame, nx: int, ny: int) -> DataFrame:
    """Every pixel of an nx x ny raster for each image_id."""
    at = F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x")
    rows = images.select("image_id", at)
    return rows.select("image_id", "x", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y"))


def _dense(counts: DataFrame, nx: int, ny: int) -> DataFrame:
    grid = _grid(counts.select("image_id").distinct(), nx, ny)
    v = F.least(F.coalesce("n", F.lit(0)), F.lit(255)).cast("double")
    return grid.join(counts, ["image_id", "x", "y"], "left").select("image_id", "x", "y", v.alias("v"))


def part_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three 50 x 50 images: line items by return flag, part size and quantity."""
    items = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    counts = joined.groupBy(F.col("l_returnflag").alias("image_id"), (F.col("p_size") - 1).alias("x"), (F.col("l_quantity").cast("int") - 1).alias("y")).agg(
        F.count("*").alias("n")
    )
    return _dense(counts, 50, 50)


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five 24 x 30 images: events by type, hour and day."""
    ev = read_table(spark, sf_dir, "events")
    counts = ev.groupBy(F.col("event_type").alias("image_id"), F.hour("ts").alias("x"), (F.day("ts") - 1).alias("y")).agg(F.count("*").alias("n"))
    return _dense(counts, 24, 30)


def event_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event images as slices of one volume, in order of their names."""
    e = event_raster(spark, sf_dir)
    slices = e.groupBy().agg(F.array_sort(F.collect_set("image_id")).alias("names"))  # one name per event type
    return e.crossJoin(F.broadcast(slices)).select(F.lit("events").alias("image_id"), "x", "y", (F.array_position("names", F.col("image_id")) - 1).cast("int").alias("z"), "v")


def embed_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 64 vectors as rows of 64 gray values; the last image may have fewer rows."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(
        F.expr("cast(vec_id div 64 as string)").alias("image_id"),
        "x",
        F.expr("cast(vec_id % 64 as int)").alias("y"),
        F.floor((F.col("e").cast("double") + 1.0) * 127.5).cast("double").alias("v"),
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts by type."""
    ev = read_table(spark, sf_dir, "events")
    idx = ((F.day("ts") - 1) * 24 + F.hour("ts")).cast("int")
    return ev.groupBy(F.col("event_type").alias("series_id"), idx.alias("idx")).agg(F.count("*").cast("double").alias("v"))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as keypoints: scene = label, image = parity, place and response from the first three components."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("scene"),
        (F.col("vec_id") % 2).cast("string").alias("image_id"),
        F.col("vec_id").alias("kp_id"),
        ((F.col("embedding")[0].cast("double") + 1.0) * 500.0).alias("x"),
        ((F.col("embedding")[1].cast("double") + 1.0) * 500.0).alias("y"),
        F.col("embedding")[2].cast("double").alias("response"),
        F.transform("embedding", lambda v: v.cast("double")).alias("descriptor"),
    )


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a byte string, where it has any bytes; the SQL view has a row for each byte."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data")).filter("octet_length(data) > 0")


# The same views for DuckDB.
SQL = {
    "part_raster": """
  SELECT g.image_id, g.x, g.y, CAST(least(coalesce(c.n, 0), 255) AS DOUBLE) AS v
  FROM (SELECT image_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y
        FROM (SELECT DISTINCT l_returnflag AS image_id FROM lineitem), range(50) t(a), range(50) u(b)) g
  LEFT JOIN (SELECT l_returnflag AS image_id, p_size - 1 AS x, CAST(l_quantity AS INT) - 1 AS y, count(*) AS n
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) c
  ON c.image_id = g.image_id AND c.x = g.x AND c.y = g.y""",
    "event_raster": """
  SELECT g.image_id, g.x, g.y, CAST(least(coalesce(c.n, 0), 255) AS DOUBLE) AS v
  FROM (SELECT image_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y
        FROM (SELECT DISTINCT event_type AS image_id FROM events), range(24) t(a), range(30) u(b)) g
  LEFT JOIN (SELECT event_type AS image_id, hour(ts) AS x, day(ts) - 1 AS y, count(*) AS n FROM events GROUP BY ALL) c
  ON c.image_id = g.image_id AND c.x = g.x AND c.y = g.y""",
    "event_volume": """
  SELECT 'events' AS image_id, x, y, CAST(dense_rank() OVER (ORDER BY image_id) - 1 AS INT) AS z, v FROM event_raster""",
    "embed_raster": """
  SELECT CAST(vec_id // 64 AS VARCHAR) AS image_id, CAST(i - 1 AS INT) AS x, CAST(vec_id % 64 AS INT) AS y,
         floor((CAST(embedding[i] AS DOUBLE) + 1.0::DOUBLE) * 127.5::DOUBLE) AS v
  FROM embeddings, range(1, 65) r(i)""",
    "signal": """
  SELECT event_type AS series_id, CAST((day(ts) - 1) * 24 + hour(ts) AS INT) AS idx, CAST(count(*) AS DOUBLE) AS v
  FROM events GROUP BY ALL""",
    "keypoints": """
  SELECT CAST(label AS VARCHAR) AS scene, CAST(vec_id % 2 AS VARCHAR) AS image_id, vec_id AS kp_id,
         (CAST(embedding[1] AS DOUBLE) + 1.0::DOUBLE) * 500.0::DOUBLE AS x,
         (CAST(embedding[2] AS DOUBLE) + 1.0::DOUBLE) * 500.0::DOUBLE AS y,
         CAST(embedding[3] AS DOUBLE) AS response, CAST(embedding AS DOUBLE[]) AS descriptor
  FROM embeddings""",
    "text_bytes": """
  SELECT doc_id, CAST(i AS INT) AS pos, CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS INT) AS byte
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM (SELECT doc_id, hex(text) AS h FROM documents))""",
}
