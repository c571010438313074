from gridloom import adapters, streaming
from gridloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_stream_of_images_equals_batch(spark, tmp_path):
    raster = adapters.part_raster(spark, SF)
    for name in ("A", "N", "R"):
        raster.filter(raster.image_id == name).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema("image_id string, x int, y int, v double").parquet(str(tmp_path / "in" / "*"))
    streaming.stream_corners(stream, lambda df, i: df.write.mode("append").parquet(out), str(tmp_path / "at")).awaitTermination(120)
    assert sorted(spark.read.parquet(out).collect()) == sorted(QUERIES["m0_top_corners"](spark, SF).collect())
