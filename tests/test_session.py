"""Intermediate tables have an owner."""

import os

import geocairn as gc
from geocairn.plans.session import scratch_dir


def folders(spark):
    return set(os.listdir(scratch_dir(spark).removeprefix("file:")))


def test_scratch_tables_go_when_asked(spark, tmp_path):
    before, mark = folders(spark), gc.scratch_mark()
    points = spark.range(500).selectExpr("id", "CAST(id % 60 AS DOUBLE) AS lat", "CAST(id % 70 AS DOUBLE) AS lon")
    queries = spark.range(5).selectExpr("id AS query_id", "CAST(id AS DOUBLE) AS qlat", "CAST(id AS DOUBLE) AS qlon")
    out = gc.knn_join(points, queries, k=2, lat="lat", lon="lon", query_lat="qlat", query_lon="qlon", tie="id")
    out.write.parquet(str(tmp_path / "out"))
    assert folders(spark) - before
    gc.drop_scratch(spark, mark)
    assert folders(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
