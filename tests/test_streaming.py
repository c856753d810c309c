from pyspark.sql import functions as F

from posekit.streaming import landing


def test_new_files_are_processed_once(spark, tmp_path):
    src, out, state = (str(tmp_path / p) for p in ("src", "out", "state"))
    for k in range(2):
        spark.createDataFrame([(k, 1.0)], "track int, x double").write.mode("append").parquet(src)
        landing.land_new(spark, src, "track int, x double", lambda d: d.withColumn("y", F.col("x") * 2), out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r["track"], r["y"], r["batch"]) for r in got.collect()) == [(0, 2.0, 0), (1, 2.0, 1)]
